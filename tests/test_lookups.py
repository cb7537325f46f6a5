from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridpanel.functions.numbers import to_number
from gridpanel.operators.resolve import resolve_entity


def test_only_plain_numbers(spark):
    texts = ["10d", "10f", "0x1p3", " 7 ", "-.5", "1e3", "nan", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r.v for r in rows.select("i", to_number(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == [None, None, None, 7.0, -0.5, 1000.0, None, None, None]


def test_repeated_mapping_entries(spark):
    facts = spark.createDataFrame([("a", 1)], "host string, n int")
    twice = spark.createDataFrame([("a", "A"), ("a", "A")], "host_raw string, host_canonical string")
    assert resolve_entity(facts, twice).count() == 1
    clash = spark.createDataFrame([("a", "A"), ("a", "B")], "host_raw string, host_canonical string")
    with pytest.raises(Exception, match="contradicting entries for a"):
        resolve_entity(facts, clash).collect()


def test_trimmed_names_that_contradict(spark):
    """Spellings that are one after trimming follow the rule of repeated entries."""
    facts = spark.createDataFrame([("b", 1)], "host string, n int")
    mapping = spark.createDataFrame([(" b", "X"), ("b ", "Y")], "host_raw string, host_canonical string")
    with pytest.raises(Exception, match="contradicting entries for b"):
        resolve_entity(facts, mapping, trim_fallback=True).collect()
    ordered = spark.createDataFrame([(" b", "X", 2), ("b ", "Y", 1)], "host_raw string, host_canonical string, position int")
    assert resolve_entity(facts, ordered, trim_fallback=True).first().host_canonical == "X"
