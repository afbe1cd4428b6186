from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kerbline.operators.units import UnitGraph, convert_speeds, number_of, speed_units, unit_in_note, unit_in_value, unit_of_setting

READ = "sequence_id string, rig_id string, recorded_at timestamp, logger_note string, max_speed_kph string, min_speed_kph string, avg_speed string"
SET = "rig_id string, valid_from timestamp, valid_to timestamp, limit_speed_unit string, avg_speed_unit string"


def value(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_units_in_values(spark):
    cases = {
        "18,5 mph": "mi/h", "mph 3.1": "mi/h", "30.1km/h": "km/h", "59 x 0.1 km/h": "0.1 km/h", "4 (0.1 km/h)": "0.1 km/h", "ca. 3.2 metres/s": "m/s", "7 MM/S": "mm/s", "7cm/s": "cm/s",
        "5 feet per second": "ft/s", "5kt": "kn", "~ 4 knots": "kn", "4 fps": "ft/s", "5.1": None, "": None, None: None, "fast": None, "5 foo": None, "12 kilometres per hour": "km/h",
    }
    assert value(spark, unit_in_value, list(cases)) == list(cases.values())
    assert value(spark, number_of, ["5,5 x", "km/h 6.9", "-3", "none", None, "~ 7"]) == ["5.5", "6.9", "-3", None, None, "7"]
    assert value(spark, unit_of_setting, ["KMH", " 0.1 km/h", "mps", "odd", None]) == ["km/h", "0.1 km/h", "m/s", None, None]


def test_notes(spark):
    cases = {
        "walked the lot at 1.4 m/s for reference marks": None, "5 km/h limit posted at the gate": None, "wind about 6 m/s during the run": None, "30 mph sign visible near the exit": None,
        "channel setting [m/s], not converted": "m/s", "Logger lief auf m/s statt km/h": "m/s", "Tempo vom Logger in Meilen pro Stunde": "mi/h", "Speed log straight from the receiver (kn)": "kn",
        "logger set to knots instead of km/h": "kn", "speeds not in km/h but mph": "mi/h", "camera cleaned": None, None: None, "encoder speed [cm/s]": "cm/s",
        "speed channel counts 0.1 km/h": "0.1 km/h", "Geschwindigkeit in Knoten, Wind 6 m/s": "kn",
    }
    assert value(spark, unit_in_note, list(cases)) == list(cases.values())


def test_precedence_and_rounding(spark):
    day = lambda d: datetime(2024, 1, d)
    sets = [("r", day(1), day(5), "m/s", "mph"), ("r", day(5), None, "km/h", "kn"), ("r", None, None, None, None)]
    reads = [
        ("a", "r", day(2), None, "10", "5 km/h", "1"), ("b", "r", day(5), None, "10", "0 mph", "1.25"), ("c", "r", day(2), "speeds in knots", "1", "1 m/s", "-"), ("d", None, day(2), None, "7", None, "1"),
        ("e", "x", None, None, "7", "", "1 mm/s"), ("a", "r", day(2), None, "10", "5 km/h", "1"),
    ]
    out = convert_speeds(spark.createDataFrame(reads, READ), spark.createDataFrame(sets, SET))
    got = {(r.sequence_id, r.field_name): (r.unit, r.unit_from, r.x) for r in out.withColumn("x", F.round(F.col("converted") * 100).cast("int")).collect()}
    assert out.count() == len(got)
    assert got[("a", "max_speed_kph")] == ("m/s", "setting", 3600) and got[("a", "avg_speed")] == ("mi/h", "setting", 161) and got[("a", "min_speed_kph")] == ("km/h", "value", 500)
    assert got[("b", "max_speed_kph")] == ("km/h", "setting", 1000) and got[("b", "avg_speed")] == ("kn", "setting", 232) and got[("b", "min_speed_kph")] == ("mi/h", "value", 0)
    assert got[("c", "max_speed_kph")] == ("kn", "note", 185) and got[("c", "min_speed_kph")] == ("m/s", "value", 360)
    assert got[("d", "max_speed_kph")] == ("km/h", "default", 700) and got[("e", "avg_speed")] == ("mm/s", "value", 0)
    assert convert_speeds(spark.createDataFrame([], READ), spark.createDataFrame([], SET)).count() == 0


def test_graph():
    to = speed_units().to("km/h")
    assert to["kn"][0] == Fraction(1852, 1000) and to["mm/s"][0] == Fraction(36, 10000) and to["ft/s"][0] == Fraction("1.09728")
    warm = UnitGraph().add("C", "K", 1, "273.15").add("F", "C", Fraction(5, 9), Fraction(-160, 9))
    warm.check_cycles()
    scale, shift = warm.to("K")["F"]
    assert scale * 212 + shift == Fraction("373.15")
    with pytest.raises(ValueError):
        speed_units().add("kn", "mi/h", 1).check_cycles()


def test_units_without_a_way_to_the_target_stay_and_thirds_are_exact(spark):
    reads = [("a", None, None, None, "30 mph", "3 km/h", None)]
    graph = UnitGraph().add("km/h", "m/s", Fraction(5, 18))
    out = {r.field_name: r for r in convert_speeds(spark.createDataFrame(reads, READ), spark.createDataFrame([], SET), graph, "m/s").collect()}
    assert out["max_speed_kph"].converted is None and out["max_speed_kph"].unit == "mi/h"
    assert abs(out["min_speed_kph"].converted * 6 - 5) < 1e-9
    reads = [("a", None, None, None, "18 km/h", "9 km/h", None)]
    out = convert_speeds(spark.createDataFrame(reads, READ), spark.createDataFrame([], SET), graph, "m/s")
    assert sorted(r.converted for r in out.collect()) == [2.5, 5]
