"""Problem 5: quantities recorded in different units, brought to one unit.

Conversions are the edges of a graph of units, each an affine function with exact rational coefficients.
``UnitGraph.to`` composes the shortest path from every unit to the target once; ``check_cycles`` verifies that all
paths between two units agree. Readings then meet the composed table in an equi-join on their source unit.

Which unit a reading has: the one written in the value itself; else the one its note states for the logged
speeds; else the setting of its recorder at the time of recording; else the target unit.

Scale: the unit table is bounded by the graph. The recorder settings are broadcast if they are below a checked
size; beyond it a shuffle join takes over, whose skew adaptive execution splits (a few recorders record most rows).
All expressions run inside the JVM.

Defined results: values that are null, blank or without a number give no row; an unknown unit text in a value does not
count as a unit; of overlapping settings the one that started last holds; a null time has no setting;
repeated rows give one result row; empty inputs give an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.text import strip
from kerbline.session import broadcast_if_small

TARGET = "km/h"
MAX_BROADCAST_SETTINGS = 100_000


@dataclass
class UnitGraph:
    """Units and affine conversions ``y = scale * x + offset`` between them."""

    edges: dict[str, dict[str, tuple[Fraction, Fraction]]] = field(default_factory=dict)

    def add(self, source: str, target: str, scale: Fraction | int | str, offset: Fraction | int | str = 0) -> UnitGraph:
        """Add a conversion and its inverse."""
        a, b = Fraction(scale), Fraction(offset)
        if not a:
            raise ValueError(f"{source} to {target}: the scale is zero")
        self.edges.setdefault(source, {})[target] = (a, b)
        self.edges.setdefault(target, {})[source] = (1 / a, -b / a)
        return self

    def to(self, target: str) -> dict[str, tuple[Fraction, Fraction]]:
        """The composition along a shortest path from each unit that reaches ``target``."""
        found, queue = {target: (Fraction(1), Fraction(0))}, deque([target])
        while queue:
            via = queue.popleft()
            a, b = found[via]
            for unit, back in sorted(self.edges.get(via, {}).items()):
                if unit not in found:
                    c, d = self.edges[unit][via]
                    found[unit] = (a * c, a * d + b)
                    queue.append(unit)
        return found

    def check_cycles(self) -> None:
        """Raise if two paths between the same units disagree."""
        for root in self.edges:
            to = self.to(root)
            for u, out in self.edges.items():
                for v, (a, b) in out.items():
                    if u in to and v in to and (to[v][0] * a, to[v][0] * b + to[v][1]) != to[u]:
                        raise ValueError(f"conversions {u} to {v} and on to {root} contradict another path")


def speed_units() -> UnitGraph:
    # fixed values: the international mile, nautical mile and foot
    graph = UnitGraph()
    graph.add("km/h", "m/h", 1000).add("m/s", "m/h", 3600).add("cm/s", "m/s", "1/100").add("mm/s", "cm/s", "1/10")
    graph.add("mi/h", "m/h", "1609.344").add("kn", "m/h", 1852).add("ft/s", "m/s", "0.3048").add("0.1 km/h", "km/h", "1/10")
    graph.check_cycles()
    return graph


# fixed values: spellings of units, as patterns over lower-case text
SPELLINGS = {
    "km/h": r"km\s?/\s?h|kmh|kph|km/hr|kilomet(?:re|er)s? (?:per|an) hour|kilomet(?:re|er)s?/h|kilometern? (?:pro|je) stunde|stundenkilometern?",
    "mi/h": r"mph|mi\s?/\s?h|mi/hr|miles? (?:per|an) hour|miles/h|meilen? (?:pro|je) stunde|meilen/h",
    "cm/s": r"cm\s?/\s?s|cm/sec|centimet(?:re|er)s? per second|centimet(?:re|er)s?/s|zentimetern? (?:pro|je) sekunde",
    "mm/s": r"mm\s?/\s?s|mm/sec|millimet(?:re|er)s? per second|millimet(?:re|er)s?/s|millimetern? (?:pro|je) sekunde",
    "ft/s": r"ft\s?/\s?s|ft/sec|fps|feet per second|foot per second|feet/s|fuß (?:pro|je) sekunde",
    "m/s": r"m\s?/\s?s|m/sec|mps|met(?:re|er)s? per second|met(?:re|er)s?/s|metern? (?:pro|je) sekunde",
    "kn": r"knots?|kn|kts?|knoten",
}
_TENTH = r"(?<![\d.,])0[.,]1\s?(?:km\s?/\s?h|kmh|kph)"
_NUMBER = r"\d+(?:[.,]\d+)?"
#: Words by which a note speaks of the logged speeds.
LOGGED = r"speeds?|tempo|geschwindigkeit\w*|logger|logged|channel|kanal|encoder|recorder|receiver|empfänger|gnss|gps|dash|export\w*|aufzeichnung"
#: Words after which a unit is the one that was not used.
_REFUSED = r"(?:statt|anstatt|anstelle von|instead of|rather than|not|nicht|never|kein|keine|no longer in|nicht mehr in)"


def _word(pattern: str) -> str:
    return rf"(?<![\p{{L}}/])(?:{pattern})(?![\p{{L}}/])"


def _first_of(text: Column, before: str = "") -> Column:
    """The unit whose spelling occurs first in lower-case ``text``, or null."""
    every = "|".join(SPELLINGS.values())
    hit = F.regexp_extract(text, rf"{before}({_word(every)})", 1)
    out = F
    for unit, pattern in SPELLINGS.items():
        out = out.when(hit.rlike(rf"\A(?:{pattern})\z"), unit)
    return out


def unit_of_setting(text: Column | str) -> Column:
    """Canonical unit of a setting; null where the spelling is unknown."""
    t = F.lower(strip(text))
    return F.when(t.rlike(rf"\A{_TENTH}\z"), "0.1 km/h").otherwise(_first_of(t))


def number_of(text: Column | str) -> Column:
    """First number of a text with point or comma as decimal mark; a minus sign directly before it counts."""
    digits = F.regexp_extract(text, rf"(-?{_NUMBER})", 1)
    return F.when(digits != "", F.replace(digits, F.lit(","), F.lit(".")))


def unit_in_value(text: Column | str) -> Column:
    """Unit written in a value such as ``18,5 mph``, ``km/h 6.9`` or ``59 x 0.1 km/h``; null where there is none."""
    t = F.lower(text)
    # a unit may stand right behind the number
    return F.when(t.rlike(rf"{_NUMBER}\s*(?:x|×|\*)?\s*\(?\s*{_TENTH}"), "0.1 km/h").otherwise(_first_of(t))


def unit_in_note(note: Column | str) -> Column:
    """Unit that a note states for the logged speeds; null where it states none.

    A unit behind a number is a quantity of its own (a limit, the wind) and does not count, nor does one that the
    note says was not used.
    """
    t = F.lower(note)
    quantity = rf"{_NUMBER}\s*(?:{'|'.join(SPELLINGS.values())})(?![\p{{L}}/])"
    tenth = t.rlike(_TENTH)
    kept = F.regexp_replace(t, quantity, " ")
    kept = F.regexp_replace(kept, rf"(?<!\p{{L}}){_REFUSED}\s+(?:in\s+|auf\s+)?(?:{'|'.join(SPELLINGS.values())})(?![\p{{L}}/])", " ")
    unit = F.when(tenth, "0.1 km/h").otherwise(_first_of(kept))
    return F.when(t.rlike(_word(LOGGED)), unit)


def conversion_table(spark: SparkSession, graph: UnitGraph, target: str) -> DataFrame:
    """(unit, times, over, plus, below) to ``target``: y = x * times / over + plus / below, whole numbers of up to 12
    digits, so that thirds and the like stay exact. One row per unit of the graph that reaches the target."""
    rows = []
    for unit, (a, b) in graph.to(target).items():
        parts = [a.numerator, a.denominator, b.numerator, b.denominator]
        if max(map(abs, parts)) >= 10**12:
            raise ValueError(f"the conversion of {unit} to {target} needs more than 12 digits")
        rows.append((unit, *map(Decimal, parts)))
    return spark.createDataFrame(rows, "unit string, times decimal(12,0), over decimal(12,0), plus decimal(12,0), below decimal(12,0)")


def convert_speeds(readings: DataFrame, settings: DataFrame, graph: UnitGraph | None = None, target: str = TARGET) -> DataFrame:
    """Every distinct reading with its source unit, where that unit was found, and its value in ``target``.

    ``readings``: sequence_id, rig_id, recorded_at, logger_note and the three speed columns. ``settings``: rig_id,
    valid_from, valid_to, limit_speed_unit, avg_speed_unit. Result: sequence_id, field_name, value (text), unit,
    unit_from (value, note, setting or default), converted (decimal; null where the graph has no way from the unit to the
    target or the number is beyond 12 digits, so that no reading is lost).
    """
    graph = graph or speed_units()
    spark = readings.sparkSession
    limits = {"max_speed_kph": "limit_unit", "min_speed_kph": "limit_unit", "avg_speed": "avg_unit"}
    rows = readings.select("sequence_id", "rig_id", "recorded_at", "logger_note", *limits)
    held = settings.filter(F.col("rig_id").isNotNull()).select(
        "rig_id",
        F.struct(
            "valid_from", "valid_to", unit_of_setting("limit_speed_unit").alias("limit_unit"), unit_of_setting("avg_speed_unit").alias("avg_unit")
        ).alias("s"),
    )
    periods = held.groupBy("rig_id").agg(F.sort_array(F.collect_set("s"), asc=False).alias("periods"))
    rows = rows.join(broadcast_if_small(periods, MAX_BROADCAST_SETTINGS), "rig_id", "left")
    at = F.col("recorded_at")
    holds = F.filter("periods", lambda s: (s["valid_from"].isNull() | (s["valid_from"] <= at)) & (s["valid_to"].isNull() | (at < s["valid_to"])))
    rows = rows.withColumns({"setting": F.get(holds, F.lit(0)), "note_unit": unit_in_note("logger_note")})
    each = F.array(
        *[F.struct(F.lit(name).alias("field_name"), F.col(name).cast("string").alias("value"), F.col(f"setting.{unit}").alias("set_unit")) for name, unit in limits.items()]
    )
    rows = rows.select("sequence_id", "note_unit", F.explode(each).alias("r")).select("sequence_id", "note_unit", "r.*")
    rows = rows.withColumns({"number": number_of("value"), "own_unit": unit_in_value("value")}).filter(F.col("number").isNotNull())
    unit = F.coalesce("own_unit", "note_unit", "set_unit", F.lit(target))
    source = (
        F.when(F.col("own_unit").isNotNull(), "value")
        .when(F.col("note_unit").isNotNull(), "note")
        .when(F.col("set_unit").isNotNull(), "setting")
        .otherwise("default")
    )
    rows = rows.select("sequence_id", "field_name", "value", F.col("number").try_cast("decimal(18,6)").alias("number"), unit.alias("unit"), source.alias("unit_from"))
    rows = rows.join(F.broadcast(conversion_table(spark, graph, target)), "unit", "left")  # one row per unit of the graph
    converted = F.col("number") * F.col("times") / F.col("over") + F.col("plus") / F.col("below")
    return rows.select("sequence_id", "field_name", "value", "unit", "unit_from", converted.alias("converted")).distinct()
