"""Long-form count profiles: (group, value, count)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbline.functions.text import split_pipe


@dataclass(frozen=True)
class Group:
    """One group of a profile. ``values`` is a text column, or an array of texts with ``many``; ``missing`` stands in
    for null and empty values (without it null counts as the empty text); ``top`` limits the group."""

    name: str
    values: Column | str
    many: bool = False
    missing: str | None = None
    top: int | None = None

    def entries(self) -> Column:
        v = F.col(self.values) if isinstance(self.values, str) else self.values
        if self.many:
            texts = v
        else:
            text = F.coalesce(v.cast("string"), F.lit(""))
            texts = F.array(F.when(text == "", self.missing).otherwise(text) if self.missing is not None else text)
        return F.transform(texts, lambda x: F.struct(F.lit(self.name).alias("group"), x.alias("value")))


def piped(name: str, column: str, top: int | None = None) -> Group:
    """A group over the parts of a ``|``-joined column."""
    return Group(name, split_pipe(column), many=True, top=top)


def counter_profile(df: DataFrame, groups: list[Group], first_seen: str | None = None) -> DataFrame:
    """Counts of all groups in one scan and one aggregation.

    Ties of a limited group go to the value seen first by ``first_seen``, else to the smaller value. Only
    limited groups are ranked, and rows beyond the largest limit are dropped before the ranking's shuffle.
    """
    entries = F.flatten(F.array(*[F.coalesce(g.entries(), F.array().cast("array<struct<group:string,value:string>>")) for g in groups]))
    rows = df.select(F.explode(entries).alias("e"), *([F.col(first_seen).alias("seen")] if first_seen else []))
    seen = F.min("seen").alias("seen") if first_seen else F.first(F.lit(0)).alias("seen")
    counts = rows.groupBy(F.col("e.group").alias("group"), F.col("e.value").alias("value")).agg(F.count("*").alias("count"), seen)
    limits = {g.name: g.top for g in groups if g.top is not None}
    if not limits:
        return counts.select("group", "value", "count")
    order = Window.partitionBy("group").orderBy(F.desc("count"), "seen", "value")
    ranked = counts.filter(F.col("group").isin(*limits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limits.values()))
    limit = F
    for name, top in limits.items():
        limit = limit.when(F.col("group") == name, top)
    out = ranked.filter(F.col("rank") <= limit).select("group", "value", "count")
    rest = [g.name for g in groups if g.top is None]
    return out.unionByName(counts.filter(F.col("group").isin(*rest)).select("group", "value", "count")) if rest else out


def overview(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) of one-row aggregates."""
    one = df.agg(*[m.cast("bigint").alias(name) for name, m in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")
