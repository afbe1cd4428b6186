"""Problem 4: a sample that meets target shares of categories in several fields at once.

The divisor method: the records of a category are numbered in random order, a record's priority is (rank - 0.5) / target of
its category, records that a category's minimum asks for come first, and the n smallest priorities are kept; the
seats of exhausted categories go to the others by themselves. For one field that is all. For several fields the target
of a record is the seats of its first field's category times a factor for its category in each other field. The factors
start from raking (wanted share / share in the pool) and are then adjusted field by field: a category's factor is scaled by the
priority of the record that its last seat asks for, until the seats of all categories are what the divisor method gives
each field alone. So the sample is always the records of smallest priority, and the factors only say which these are.

Scale: a category may hold most rows, so its ranks come from counts of hash ranges plus the position inside a range: no
task sees a whole category. Every adjustment is one aggregation to counts by category and priority bin, so what reaches the
driver has the size of the target table, whatever the pool. The n-th priority is found by bins too, never by a global
sort; only records between two neighbouring bins are put in order.

Defined results: null and blank categories and those without target belong to no target category and are taken last;
repeated rows of one sequence count once (in the sample with the smallest spelling, in the report with each of its
categories); null ids are not part of the pool; repeated targets each get their row; of repeated targets of a category
the largest share and minimum hold for the sample; an empty pool gives an empty sample and reports all targets
with a positive minimum; without targets sample and report are empty; a minimum is kept as far as the sample has room; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from kerbline.functions.text import split_pipe, strip
from kerbline.session import broadcast_if_small

FIELDS = ("preferred_camera_rule", "weather_tags", "approach", "target_object")
#: Fields that join several values with ``|``; the first non-blank one counts.
MULTI_VALUED = ("weather_tags",)
#: Hash ranges of a category.
RANGES = 1024
#: Targets up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST_TARGETS = 10_000
#: Priority bins of an adjustment, adjustments at most, and rounds over all fields that may pass without a better result.
BINS, ADJUSTMENTS, PATIENCE = 128, 64, 2
#: Records at the n-th priority that are put in order at most before the bins are refined.
BOUNDARY = 10_000
SALTS = 64
#: Factor of records without a target category: they come behind all others.
OUTSIDE = 1e-9


def category_key(field: str) -> Column:
    """Normalised category of a field, or null."""
    text = F.get(split_pipe(field), F.lit(0)) if field in MULTI_VALUED else strip(field)
    key = F.lower(text)
    return F.when(key != "", key)


def _wanted(targets: DataFrame) -> DataFrame:
    """The targets with their normalised key; rows without field or category are none."""
    rows = targets.select(
        "field_name", "category", F.coalesce("target_permille", F.lit(0)).alias("target_permille"), F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.lower(strip("category")).alias("key")
    )
    return rows.filter(F.col("category").isNotNull() & F.col("field_name").isNotNull())


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "sequence_id")


def _numbered(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """``rows`` with ``rank``: their row number among those of equal ``keys``, in the order of a hash of seed and id."""
    rows = rows.withColumn("_order", _order(seed)).withColumn("_range", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(RANGES)))
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_order", "sequence_id")
    rows = rows.withColumn("_place", F.row_number().over(inside)).join(before, [*keys, "_range"])
    return rows.withColumn("rank", F.col("_place") + F.col("_before")).drop("_order", "_range", "_place", "_before")


def priorities(candidates: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(sequence_id, field_name, key, rank, priority, is_floor) of every record in every target category it belongs to.

    The category with empty names holds all sequences; its ranks count the pool.
    """
    base = candidates.filter(F.col("sequence_id").isNotNull()).select("sequence_id", *[category_key(f).alias(f) for f in FIELDS])
    names = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key")) for f in FIELDS], F.struct(F.lit("").alias("field_name"), F.lit("").alias("key")))
    # one row per sequence first: repeated rows collapse before anything is ranked
    once = base.groupBy("sequence_id").agg(F.array_distinct(F.flatten(F.collect_set(names))).alias("c"))
    each = once.select("sequence_id", F.explode(F.filter("c", lambda c: c["key"].isNotNull())).alias("c")).select("sequence_id", "c.*")
    largest = _wanted(targets).groupBy("field_name", "key").agg(F.max("target_permille").alias("permille"), F.max("min_rows").alias("least"))
    largest = largest.unionByName(largest.sparkSession.createDataFrame([("", "", 0, 0)], "field_name string, key string, permille int, least int"))
    each = each.join(broadcast_if_small(largest, MAX_BROADCAST_TARGETS), ["field_name", "key"])
    ranked = _numbered(each, ["field_name", "key"], seed)
    priority = F.when(F.col("permille") > 0, (F.col("rank") - 0.5) * 1000 / F.col("permille"))
    return ranked.select("sequence_id", "field_name", "key", "rank", priority.alias("priority"), (F.col("rank") <= F.col("least")).alias("is_floor"))


def shortfalls(candidates: DataFrame, targets: DataFrame, fraction: int = 10, seed: int = 42) -> DataFrame:
    """Each target with what the divisor method finds for it: field_name, category, target_permille, min_rows, available,
    sample_size, last_priority, floor_rows and unmet.

    A category is exhausted if its last record's priority lies more than half a seat below the sample size, that is, if a
    record is due which it does not have; its minimum is missed if fewer records come first than it asks for.
    """
    ranked = priorities(candidates, targets, seed)
    found = ranked.groupBy("field_name", "key").agg(F.max("rank").alias("available"), F.max("priority").alias("last_priority"), F.count_if("is_floor").alias("floor_rows"))
    wanted = _wanted(targets)
    marker = wanted.sparkSession.createDataFrame([("", "", 0, 0, "")], "field_name string, category string, target_permille int, min_rows int, key string")
    rows = wanted.unionByName(marker).join(found, ["field_name", "key"], "left")
    pool = F.max(F.when(F.col("field_name") == "", F.col("available"))).over(Window.partitionBy())  # one row per target
    rows = rows.withColumn("sample_size", F.floor(F.coalesce(pool, F.lit(0)) / fraction)).filter("field_name <> ''")
    available, floor_rows = F.coalesce("available", F.lit(0)), F.coalesce("floor_rows", F.lit(0))
    half_seat = F.when(F.col("target_permille") > 0, F.lit(500.0) / F.col("target_permille"))
    due = F.coalesce(F.col("last_priority") + half_seat < F.col("sample_size") + 1e-6 * (F.col("sample_size") + 1), F.col("target_permille") > 0)
    exhausted = due & (available * 1000 < F.col("target_permille") * F.col("sample_size"))  # exact check: whole numbers
    return rows.select(
        "field_name", "category", "target_permille", "min_rows", available.alias("available"), "sample_size", "last_priority", floor_rows.alias("floor_rows"),
        (exhausted | (floor_rows < F.col("min_rows"))).alias("unmet"), "key",
    )


def unmet_targets(candidates: DataFrame, targets: DataFrame, fraction: int = 10) -> DataFrame:
    """(field_name, category) of the targets that the pool cannot meet."""
    return shortfalls(candidates, targets, fraction).filter("unmet").select("field_name", "category").distinct()


def divisor_seats(counts: np.ndarray, shares: np.ndarray, floors: np.ndarray, size: int) -> np.ndarray:
    """Seats per category: the ``size`` smallest priorities (rank - 0.5) / share, floor records first, ties by category."""
    size = int(min(size, counts.sum()))
    seats = np.minimum(floors, counts).astype(np.int64)
    if seats.sum() >= size:
        return seats
    live = shares > 0

    def at(level: float) -> np.ndarray:
        k = np.zeros(len(counts), dtype=np.int64)
        k[live] = np.minimum(np.floor(level * shares[live] + 0.5), counts[live]).astype(np.int64)
        return np.maximum(seats, k)

    low, high = 0.0, 1.0
    while at(high).sum() < size and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() <= size else (low, mid)
    out = at(low)
    while out.sum() < size:  # ties at the last level, or only categories without a share are left
        room = out < counts
        priority = np.where(live & room, (out + 0.5) / np.where(live, shares, 1.0), np.inf)
        best = int(np.argmin(priority)) if np.isfinite(priority).any() else int(np.argmax(room))
        take = 1 if np.isfinite(priority).any() else int(min(size - out.sum(), counts[best] - out[best]))
        out[best] += take
    return out


def _scale(counts: np.ndarray, edges: np.ndarray, goal: int) -> float:
    """The priority up to which a category has ``goal`` records, of its counts by bin (the first: below all edges)."""
    upto = np.cumsum(counts)[:-1]  # records with a priority up to each edge
    best = np.flatnonzero(np.abs(upto - goal) == np.abs(upto - goal).min())
    return float(2.0 ** edges[best].mean())


class Balance:
    """Factors of categories under which the records of smallest priority have the wanted seats in every field."""

    def __init__(self, records: DataFrame, goals: list[np.ndarray], available: list[np.ndarray], size: int) -> None:
        """``records``: sequence_id, rank, and for each field f ``k<f>``, the number of its category (the last: no target)."""
        self.records, self.goals, self.size = records, goals, size
        pool = max(1, available[0].sum())
        share = lambda g, a: np.where(a > 0, (g / max(1, size)) / (np.maximum(a, 1) / pool), 1.0)
        self.factors = [np.append(np.maximum(goals[0], 1e-3), OUTSIDE)] + [np.append(np.maximum(share(g, a[:-1]), 1e-6), OUTSIDE) for g, a in zip(goals[1:], available[1:])]

    def priority(self) -> Column:
        """(rank - 0.5) / target of a record."""
        target = F.lit(1.0)
        for f, factors in enumerate(self.factors):
            target = target * F.get(F.array(*[F.lit(float(x)) for x in factors]), F.col(f"k{f}"))
        return (F.col("rank") - 0.5) / target

    def bins(self, reach: float) -> tuple[list[np.ndarray], np.ndarray]:
        """(counts of each field's categories by bin, edges of the bins as binary logarithms of the priority)."""
        step = 2 * reach / BINS
        at = F.least(F.greatest(F.ceil((F.log2(self.priority()) + reach) / step), F.lit(0)), F.lit(BINS + 1)).cast("int")
        fields = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"k{f}").alias("k")) for f in range(len(self.goals))])
        each = self.records.select(at.alias("bin"), *[f"k{f}" for f in range(len(self.goals))]).select("bin", F.explode(fields).alias("c")).select("bin", "c.*")
        out = [np.zeros((len(x), BINS + 2), dtype=np.int64) for x in self.factors]
        for f, k, b, n in each.groupBy("f", "k", "bin").agg(F.count("*")).collect():  # of the size of the target table
            out[f][k, b] = n
        return out, np.linspace(-reach, reach, BINS + 1)

    def adjust(self) -> None:
        best, least, since = [x.copy() for x in self.factors], np.inf, 0
        fields = len(self.goals)
        for step in range(ADJUSTMENTS):
            counts, edges = self.bins(3.0 if step < 2 * fields else 1.0 if step < 4 * fields else 0.4)
            apart = [np.abs(c[:-1, : BINS // 2 + 1].sum(axis=1) - g) for c, g in zip(counts, self.goals)]
            miss = float(sum(x.sum() for x in apart))
            since += 1
            if miss < least:
                best, least, since = [x.copy() for x in self.factors], miss, 0
            if not miss or since > PATIENCE * fields:
                break
            f = step % fields
            for k, goal in enumerate(self.goals[f]):
                if counts[f][k].sum() and apart[f][k]:
                    self.factors[f][k] = min(max(self.factors[f][k] * _scale(counts[f][k], edges, int(goal)), 1e-12), 1e15)
        self.factors = best


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest (priority, sequence_id), found by bins of the priority and without a global sort."""
    if n <= 0:
        return rows.limit(0)
    low, high, below, span = -1100.0, 1100.0, 0, None
    log = F.log2("priority")
    for _ in range(60):
        step = (high - low) / BINS
        at = F.least(F.greatest(F.ceil((log - low) / step), F.lit(0)), F.lit(BINS + 1)).cast("int")
        counts = np.zeros(BINS + 2, dtype=np.int64)
        for b, k in rows.filter((log > low) & (log <= high)).groupBy(at).agg(F.count("*")).collect():  # one row per bin
            counts[b] = k
        upto = below + np.cumsum(counts)
        if upto[-1] <= n:
            return rows.filter(log <= high) if span else rows
        at_n = int(np.searchsorted(upto, n))
        below, low, high = int(upto[at_n - 1]) if at_n else below, low + (at_n - 1) * step, low + at_n * step
        span = high - low
        if upto[at_n] - below <= BOUNDARY or span < 1e-12:
            break
    sure = rows.filter(log <= low)
    return sure.unionByName(rows.filter(log > low).filter(log <= high + span).orderBy("priority", "sequence_id").limit(n - sure.count()))


def _floor_ids(records: DataFrame, floors: list[np.ndarray]) -> DataFrame:
    """Ids of the records that come first: of each category the smallest priorities, as many as its minimum."""
    out = records.select("sequence_id").limit(0)
    for f, least in enumerate(floors):
        if not least.any():
            continue
        wanted = F.get(F.array(*[F.lit(int(x)) for x in np.append(least, 0)]), F.col(f"k{f}"))
        rows = records.select("sequence_id", "priority", F.col(f"k{f}").alias("k"), wanted.alias("w")).filter("w > 0").withColumn("salt", F.pmod(F.xxhash64("sequence_id"), F.lit(SALTS)))
        # salted first, so that a category that holds most rows is cut in many tasks
        for keys in (["k", "salt"], ["k"]):
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "sequence_id"))).filter("_r <= w").drop("_r")
        out = out.unionByName(rows.select("sequence_id"))
    return out.distinct()


REPORT = (
    "field_name string, category string, target_permille int, min_rows int, available bigint, sample_size bigint, seats bigint, sampled bigint, unmet boolean, reason string"
)


def draw_sample(candidates: DataFrame, targets: DataFrame, fraction: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report). Runs its counting jobs when called; the persisted records are freed with Spark's cache.

    sample: sequence_id, the category keys, rank (in the first field's category), priority, is_floor. report: field_name,
    category, target_permille, min_rows, available, sample_size, seats (what the divisor method gives the field alone), sampled,
    unmet (the pool cannot meet it) and reason, null where the sample is within one row of the target:
    ``exhausted`` or ``below_minimum`` (the pool has too few), ``raised_to_minimum``, ``redistributed`` (seats moved by
    exhausted categories and minimums of the same field) or ``other_fields`` (not reachable together with their targets).
    """
    spark = candidates.sparkSession
    found = shortfalls(candidates, targets, fraction, seed).collect()  # the target table
    size = int(found[0].sample_size) if found else 0
    facts: list[dict[str, list[int]]] = []
    for name in FIELDS:
        own: dict[str, list[int]] = {}
        for r in sorted((r for r in found if r.field_name == name), key=lambda r: (r.key, r.category)):
            permille, least, _ = own.get(r.key, (0, 0, 0))
            own[r.key] = [max(permille, r.target_permille), max(least, r.min_rows), r.available]
        facts.append(own)
    floors = [np.array([x[1] for x in own.values()], dtype=np.int64) for own in facts]
    held = [np.array([x[2] for x in own.values()], dtype=np.int64) for own in facts]
    goals = [divisor_seats(h, np.array([x[0] / 1000 for x in own.values()]), np.minimum(least, size), size) for own, h, least in zip(facts, held, floors)]
    records = pool(candidates)
    number = spark.createDataFrame([(f, key, k) for f, own in enumerate(facts) for k, key in enumerate(own)], "f int, key string, k int")
    for f, name in enumerate(FIELDS):
        of = broadcast_if_small(number.filter(F.col("f") == f).select(F.col("key").alias(name), F.col("k").alias(f"k{f}")), MAX_BROADCAST_TARGETS)
        records = records.join(of, name, "left").withColumn(f"k{f}", F.coalesce(f"k{f}", F.lit(len(facts[f]))))
    records = _numbered(records, ["k0"], seed).persist(StorageLevel.MEMORY_AND_DISK)
    counted = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"k{f}").alias("k")) for f in range(len(FIELDS))])).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    available = [np.zeros(len(own) + 1, dtype=np.int64) for own in facts]
    for (f, k), n in counted.collect():  # of the size of the target table
        available[f][k] = n
    balance = Balance(records, goals, available, size)
    if size:
        balance.adjust()
    rows = records.withColumn("priority", balance.priority())
    first = _floor_ids(rows, [np.minimum(x, size) for x in floors]).withColumn("is_floor", F.lit(True))
    rows = rows.join(first, "sequence_id", "left").withColumn("is_floor", F.coalesce("is_floor", F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
    floor_rows = rows.filter("is_floor")
    n_floor = floor_rows.count()
    sample = _smallest(floor_rows, size) if n_floor > size else floor_rows.unionByName(_smallest(rows.filter("not is_floor"), size - n_floor))
    sample = sample.select("sequence_id", *FIELDS, "rank", "priority", "is_floor", *[f"k{f}" for f in range(len(FIELDS))])

    drawn = [np.zeros(len(own) + 1, dtype=np.int64) for own in facts]
    for (f, k), n in sample.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"k{f}").alias("k")) for f in range(len(FIELDS))])).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect():
        drawn[f][k] = n
    report = []
    for r in found:
        if r.field_name in FIELDS:
            f = FIELDS.index(r.field_name)
            k = list(facts[f]).index(r.key)
            seats, sampled = int(goals[f][k]), int(drawn[f][k])
        else:
            seats = sampled = 0
        due = r.target_permille * r.sample_size / 1000
        reason = None
        if r.unmet:
            reason = "exhausted" if r.available * 1000 < r.target_permille * r.sample_size else "below_minimum"
        elif abs(sampled - due) >= 1:
            reason = "other_fields" if abs(sampled - seats) >= 1 else "raised_to_minimum" if sampled == r.min_rows > due else "redistributed"
        report.append((r.field_name, r.category, r.target_permille, r.min_rows, r.available, r.sample_size, seats, sampled, r.unmet, reason))
    return sample.drop(*[f"k{f}" for f in range(len(FIELDS))]), spark.createDataFrame(report, REPORT)


def pool(candidates: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per sequence: sequence_id and its category keys."""
    keys = candidates.filter(F.col("sequence_id").isNotNull()).select("sequence_id", *[category_key(f).alias(f) for f in fields])
    return keys.groupBy("sequence_id").agg(*[F.min(f).alias(f) for f in fields])
