from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridpanel.functions.text import LABEL_METRICS
from gridpanel.operators import layout, scan
from tests.grids import cells, rows_of, sheet


@pytest.mark.parametrize("block", [1, 3, 65536])
def test_fill_down_across_blocks(spark, block):
    rng = random.Random(block)
    rows = [(f, "S", r, rng.choice([None, None, f"v{r}"])) for f in ("a", "b") for r in range(1, 40) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "file_id string, sheet string, r bigint, host string")
    want, last = [], {}
    for f, s, r, v in rows:
        last[f] = v or last.get(f)
        want.append((f, r, last[f]))
    got = rows_of(scan.carry_forward(df, "host", block_rows=block), "file_id", "r", "host")
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def expected_states(rows):
    """Plain walk down the sheet: (row, species, metric) of rows carrying a value."""
    def metric_of(name, unit):
        low = name.lower()
        if "добуто" in low:
            return "shot_tons" if unit and "тонн" in unit.lower() else "shot_heads"
        return next((m for word, m in LABEL_METRICS if word in low), None)

    out, species = [], None
    for i, (code, name, unit) in enumerate(rows):
        coded = code is not None and code.strip() != ""
        if coded and code.strip() == "Код тварини":
            species = None
        elif name is None:
            pass
        elif coded and int(float(code)) % 100 == 0:
            species = None
        elif coded:
            species = name.split(" -")[0].strip()
            follower = rows[i + 1] if i + 1 < len(rows) else (None, None, None)
            alone = (follower[0] or "").strip() != "" or follower[1] is None
            if " -" in name or alone:
                out.append((i, species, metric_of(name, unit) or "count"))
        elif species is not None and metric_of(name, unit):
            out.append((i, species, metric_of(name, unit)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_state_machine_against_a_walk(spark, seed):
    rng = random.Random(seed)
    codes = [None, None, None, "", " ", "100", "101", "205", "300", "Код тварини"]
    names = [None, "Лось", "Лось - загальна кількість", "Кабан -добуто", "Добуто", "розселено", "інше", "Відловлено"]
    rows = [(rng.choice(codes), rng.choice(names), rng.choice([None, "тонн", "голів"])) for _ in range(60)]
    grid = cells(spark, sheet("f", 2001, "S", 0, [list(r) for r in rows], width=3))
    flat = scan.grid_rows(grid, {0: "code", 1: "name", 2: "unit"}, {0: "next_code", 1: "next_name"})
    got = [tuple(r) for r in scan.species_state(flat, block_rows=7).select("r", "species", "metric").orderBy("r").collect()]
    assert got == expected_states(rows)


def test_relocation_events_keep_the_first_header(spark):
    grid = cells(spark, sheet("f", 2019, "S", 0, [["Користувач", "Вид"], ["A", "x", "1"], [None, "y", "2"]], width=5))
    log = scan.relocation_events(grid, layout.header_row(grid, "Користувач"), block_rows=2)
    assert rows_of(log, "host", "species", "count") == [("A", "X", 1.0), ("A", "Y", 2.0)]


def test_relocation_events_clean_a_species_per_spelling(spark):
    """Rows meet cleaned spellings and carried hosts by broadcast; they aren't cleaned or dealt out again."""
    body = [["Користувач", "Вид"], [None, "x"], ["0501234567", "x"], [None, "x"], [" A ", " лось*"], [None, "всього"], [None, None], [None, " лось*"], [None, ""]]
    grid = cells(spark, sheet("f", 2019, "S", 0, body, width=5))
    log = scan.relocation_events(grid, layout.header_row(grid, "Користувач"), block_rows=3)
    assert rows_of(log, "host", "species", "count") == [("A", "Лось", None), ("A", "Лось", None), ("Користувач", "X", None)]
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(_blk" not in plan


def test_lookahead_uses_row_numbers(spark):
    grid = cells(spark, [("f", 1, "S", 0, 0, 0, "a"), ("f", 1, "S", 0, 2, 0, "b"), ("f", 1, "S", 0, 3, 0, "c")])
    rows = scan.grid_rows(grid, {0: "x"}, {0: "next_x"})
    assert rows_of(rows, "r", "x", "next_x") == [(0, "a", None), (2, "b", "c"), (3, "c", None)]
    assert rows.filter(F.col("r") < 0).count() == 0


def test_state_rows_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """Tasks follow the number of lines; rows are those of the view's SQL."""
    from suite import tables, views

    rows = [(i, i % 23 or None, 1, 1, 1.0, 1.0, 0.0, 0.0, "RAN"[i % 3], "O", None) for i in range(400)]
    lines = spark.createDataFrame(rows, tables.SCHEMAS["lineitem"])
    lines = lines.withColumn("l_shipdate", F.expr("CAST(make_date(CAST(1992 + l_orderkey % 5 AS INT), 3, 4) AS TIMESTAMP_NTZ)"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(views, "STATE_TASK_ROWS", 60)
    got = views.state_rows(spark, str(tmp_path))
    want = spark.sql(views.SQL["state_rows"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.select(*got.columns).collect())))
    assert got.rdd.getNumPartitions() == 7
