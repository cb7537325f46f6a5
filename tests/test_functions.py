from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import numbers as N
from gridpanel.functions import text as X


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_strip_any_white_space(spark):
    spaces = ["\t", "\n", "\x0b", " ", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000"]
    given = [f"{a}Козуля {b}x{b}" for a in spaces for b in spaces] + ["", " ", None, "a", "\x1cq\x1f", "звір", "😀 ", "\u200bz", "\u1681 a"]
    want = [f"Козуля {b}x" for _ in spaces for b in spaces] + ["", "", None, "a", "\x1cq\x1f", "звір", "😀", "\u200bz", "\u1681 a"]
    assert apply(spark, X.strip_text, given) == want


def test_species_middle_era(spark):
    given = ["  Кабан  звич.** ", "Інші", "інші", "копитні-всього", "УСЬОГО копитних", "", None, 'a- b"c"', " лис * "]
    want = ["Кабан звич.", None, "інші", None, None, "", None, "a-b'c'", "лис"]
    assert apply(spark, X.norm_species_v1, given) == want


def test_species_late_era(spark):
    given = [
        "кабан дикий", "байбак", "інші", "Всього копитних", "копитні-всього", "Копитні -УСЬОГО",
        "x (у тому числі)", "", None, "a * **", "лис-всього-1", "ІНШІ",
    ]
    want = ["Кабан дикий", "Бабак", None, None, "Копитні", "Копитні", None, None, None, "A *", "Лис-всього-1", "ІНШІ"]
    assert apply(spark, X.norm_species_v2, given) == want


def test_totals(spark):
    given = ["ДКЛГ - усього", "Всього", "по Області", "Разом", "у тому числі", "Городоцьке ЛГ", None]
    assert apply(spark, X.is_aggregate, given) == [True, True, True, False, False, False, None]
    assert apply(spark, lambda c: X.is_aggregate(c, True), given) == [True, True, True, True, True, False, None]


def test_contaminants(spark):
    given = ["тел 050123456", "тел 0501234567", "05012 34567", "Operator Name", "clean"]
    assert apply(spark, lambda c: X.is_contaminant(c, ["operator"]), given) == [False, True, False, True, False]


@pytest.mark.parametrize(
    "label, species",
    [("Зубр - загальна кількість", "Зубр"), ("Лось -добуто", "Лось"), ("Вовк", "Вовк"), (" a - b - c", "a"), ("a-b", "a-b")],
)
def test_species_from_label(spark, label, species):
    assert apply(spark, X.species_from_label, [label]) == [species]


def test_detect_metric(spark):
    rows = [
        ("Добуто, загальна кількість", "Тонн", "shot_tons"), ("добуто", None, "shot_heads"),
        ("Загальна кількість", "голів", "count"), ("розселено", None, "relocated"), ("відловлено", None, "caught"),
        ("Виявлено загиблими", None, "found_dead"), ("інше", "тонн", None), (None, "тонн", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, u string, w string")
    got = df.select("i", X.detect_metric(F.col("n"), F.col("u")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [r[2] for r in rows]


def test_codes(spark):
    codes = ["100", "100.0", "105", "", " ", "Код тварини", None, "x"]
    assert apply(spark, X.is_species_header, codes) == [True, True, True, False, False, False, False, True]
    assert apply(spark, X.is_group_code, codes) == [True, True, False, False, False, False, False, False]


def test_numbers(spark):
    assert apply(spark, N.to_number, ["5", " 5 ", "x", "", "nan", "1 234", None, "-2.5", "1e3"]) == [
        5.0, 5.0, None, None, None, None, None, -2.5, 1000.0,
    ]
    assert apply(spark, lambda c: N.round_report(c.cast("double"), 1), ["0.25", "0.35", "-0.25"]) == [0.2, 0.4, -0.2]
    assert apply(spark, lambda c: N.ratio(c.cast("double"), F.lit(0.0)), ["1"]) == [None]
