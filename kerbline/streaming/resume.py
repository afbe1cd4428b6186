"""The review loop as a stream: rows that arrive are reviewed once, results are appended, a restart goes on.

The stream's checkpoint remembers which input was read; the anti-join with what is already written makes a batch that is
repeated after a failure harmless. Nothing written is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators.review import Reviewer, RuleReviewer, review, unreviewed


def review_stream(spark: SparkSession, source: str, target: str, checkpoint: str, make_reviewer: Callable[[], Reviewer] = RuleReviewer) -> StreamingQuery:
    """Review the Parquet rows that appear in ``source`` and append the results to ``target``; ends with the input."""
    schema = spark.read.parquet(source).schema

    def handle(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        try:
            done = own.read.parquet(target)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        todo = unreviewed(batch, done) if done is not None else batch
        review(todo, make_reviewer).write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
