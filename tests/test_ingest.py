"""The same three entities reported in the five layouts give the same facts."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridpanel.operators import layout, reshape, scan
from gridpanel.plans import final, ingest
from tests.grids import cells, rows_of, sheet

HOSTS = ["Альфа", "Бета"]
COUNTS = {"Лось": [3, 4], "Кабан": [10, None]}


def fact_rows(df):
    return rows_of(df, "host", "species", "metric", "value")


WANT_COUNTS = sorted(
    [(h, s, "count", None if COUNTS[s][i] is None else float(COUNTS[s][i])) for s in COUNTS for i, h in enumerate(HOSTS)],
    key=lambda t: tuple((x is None, str(x)) for x in t),
)


def early_sheet():
    rows = [[None] * 6 for _ in range(60)]
    rows[4][1] = "Найменування показників"
    rows[4][3], rows[4][4], rows[4][5] = "Альфа", "Бета", "Всього"
    for offset, a, b in ((2, 100, 200), (3, 90, "x"), (11, 7, 8), (25, 1, 2)):
        rows[4 + offset][3:6] = [a, b, 999]
    body = [
        ("100", "Копитні", "голів", 1, 1), (None, "Добуто", "голів", 5, 5),
        ("101", "Лось - загальна кількість", "голів", 3, 4), (None, "Добуто", "голів", 1, 0), (None, "Добуто", "тонн", 0.1, 0),
        (None, None, None, 9, 9), (None, "розселено", None, 2, None),
        ("102", "Кабан", "голів", None, None), (None, "загальна кількість", "голів", 10, None), ("Код тварини", "Назва", None, None, None),
        (None, "Добуто", "голів", 77, 77), ("103", "Вовк", "голів", 6, 7), ("104", "Лис", "голів", 8, 9),
    ]
    for i, row in enumerate(body):
        rows[33 + i][:5] = row
    rows[50][0] = "Розділ ІV"
    rows[51][:4] = ["105", "Поза секцією", "голів", 1]
    return sheet("e", 2005, "Лист1", 0, rows)


def test_early_era(spark):
    tables = ingest.ingest_early(cells(spark, early_sheet()))
    meta = rows_of(tables["hosts_meta"], "host", "metric", "value")
    assert ("Альфа", "area_total", 100.0) in meta and ("Бета", "area_managed", None) in meta
    assert not any(h == "Всього" for h, _, _ in meta) and len(meta) == 12
    assert ("Бета", "total_expenses", 8.0) in rows_of(tables["finances"], "host", "metric", "value")
    counted = fact_rows(tables["populations"])
    assert [r for r in counted if r[1] in COUNTS] == WANT_COUNTS
    assert {r[1] for r in counted} == {"Лось", "Кабан", "Вовк", "Лис"}
    assert {(r[1], r[2]) for r in fact_rows(tables["harvest"])} == {("Лось", "shot_heads"), ("Лось", "shot_tons")}
    assert fact_rows(tables["relocation"]) == [("Альфа", "Лось", "relocated", 2.0), ("Бета", "Лось", "relocated", None)]


def main_sheet(name, header_row, width, values, header_width=25):
    rows = [[None] * width for _ in range(header_row + 1)]
    rows[header_row][0] = "Користувач угідь"
    for host, cols in values:
        row = [None] * width
        row[0] = host
        for c, v in cols.items():
            row[c] = v
        rows.append(row)
    return rows


def test_middle_era(spark):
    rows = main_sheet(
        "2-тп 1", 3, 238,
        [(" Альфа ", {1: 100, 10: 7, 80: 1, 124: 2}), ("Бета", {1: "x", 10: 8, 124: 3}), ("ДКЛГ - усього", {1: 999}), (None, {1: 5})],
    )
    rows[2][80], rows[2][124], rows[2][125] = "Лось*", "Лось", "Інші"
    census = [[None], ["Користувач", None, "Лось", "Кабан ", "Всього"], ["Альфа", 1, 3, 10, 13], ["Бета", 1, 4, None, 4]]
    tables = ingest.ingest_middle(
        cells(spark, sheet("m", 2014, "2-тп 1", 0, rows), sheet("m", 2014, "облік ", 1, census), sheet("m", 2014, "облік", 2, census[:2]))
    )
    assert fact_rows(tables["populations"]) == WANT_COUNTS
    assert fact_rows(tables["harvest"]) == [("Альфа", "Лось", "shot_heads", 2.0), ("Бета", "Лось", "shot_heads", 3.0)]
    assert fact_rows(tables["relocation"]) == [("Альфа", "Лось", "relocated", 1.0), ("Бета", "Лось", "relocated", None)]
    assert ("Бета", "area_total", None) in rows_of(tables["hosts_meta"], "host", "metric", "value")
    assert rows_of(tables["finances"].filter("metric = 'total_expenses'"), "host", "value") == [("Альфа", 7.0), ("Бета", 8.0)]


def events_sheet(file_id, period, name, order):
    return sheet(file_id, period, name, order, [
        ["Розселення тварин"], [None, None], ["Користувач", "Вид", "К-сть", "Місце", "Походження"],
        ["Альфа ", "кабан", "5", " ліс ", None], [None, "Інші", 1, None, None], [None, "лось", "x", None, "вольєр"],
        ["Всього по області", "кабан", 9, None, None], ["0501234567", "кабан", 2, None, None], ["Бета", None, 4, None, None], [None, "лось", 4, "a", "b"],
    ])


WANT_EVENTS = [
    ("Альфа", "Кабан", 5.0, "ліс", None), ("Альфа", "Лось", None, None, "вольєр"), ("Бета", "Лось", 4.0, "a", "b"),
]


def sections_rows(shift=0):
    """Section header row, species row and user row, optionally shifted right."""
    pad = [None] * shift
    head = [None, *pad, "Чисельність копитних", None, None, "Чисельність хутрових", "Чисельність пернатих",
            "Кількість добутих (вилучених) копитних", None, "Кількість добутих (вилучених) хутрових", "Кількість добутих (вилучених) пернатих"]
    species = [None, *pad, "лось", "Кабан", "Всього копитних", None, "Інші", "Лось", "Кабан", None, None]
    alpha = ["Альфа", *pad, 3, 10, 13, None, 1, 1, 2, None, None]
    beta = ["Бета", *pad, 4, None, 4, None, 1, None, 5, None, None]
    return head, species, alpha, beta


WANT_SHOT = [("Альфа", "Кабан", "shot_heads", 2.0), ("Альфа", "Лось", "shot_heads", 1.0),
             ("Бета", "Кабан", "shot_heads", 5.0), ("Бета", "Лось", "shot_heads", None)]


def test_hybrid_era(spark):
    head, species, alpha, beta = sections_rows(shift=16)
    alpha[1], alpha[10], beta[14] = 100, 7, 2
    user = ["Користувач"] + [None] * 24
    rows = [head, [None], species, user, alpha, beta, ["Разом", *[1] * 20]]
    tables = ingest.ingest_hybrid(
        cells(spark, sheet("h", 2018, "2-тп 1", 0, rows), events_sheet("h", 2018, "12.Розселення", 1))
    )
    assert fact_rows(tables["populations"]) == WANT_COUNTS
    assert fact_rows(tables["harvest"]) == WANT_SHOT
    assert rows_of(tables["relocation"], "host", "species", "count", "location", "origin") == WANT_EVENTS
    assert ("Бета", "expense_breeding", 2.0) in rows_of(tables["finances"], "host", "metric", "value")


def test_hybrid_work_is_narrowed(spark, monkeypatch):
    """Only the main sheet is melted, hosts are cleaned in their own cells, and blank cells of the log don't travel."""
    head, species, alpha, beta = sections_rows(shift=16)
    user = ["Користувач"] + [None] * 24
    seen = {}
    melt, rows_of_grid = reshape.melt_keyed, scan.grid_rows

    def melted(cells, *args):
        seen["sheets"] = {r["sheet"] for r in cells.select("sheet").distinct().collect()}
        facts = melt(cells, *args)
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        seen["after"] = plan[: plan.index("Window")]
        return facts

    def gridded(cells, *args, **kwargs):
        seen["blank"] = cells.filter("v IS NULL").count()
        return rows_of_grid(cells, *args, **kwargs)

    monkeypatch.setattr(reshape, "melt_keyed", melted)
    monkeypatch.setattr(scan, "grid_rows", gridded)
    ingest.ingest_hybrid(
        cells(spark, sheet("h", 2018, "2-тп 1", 0, [head, [None], species, user, alpha, beta]), events_sheet("h", 2018, "12.Розселення", 1))
    )
    assert seen["sheets"] == {"2-тп 1"}
    assert "усього" not in seen["after"]
    assert seen["blank"] == 0


def late_main(period, name):
    rows = main_sheet(name, 2, 21, [("Альфа", {1: 1.5, 10: 7}), ("Бета", {18: 3}), ("Усього", {1: 9})])
    rows.insert(3, [None] * 21)
    return sheet("n", period, name, 0, rows)


@pytest.mark.parametrize("shift", [0, 3])
def test_late_era(spark, shift):
    head, species, alpha, beta = sections_rows(shift)
    user = ["Користувач"] + [None] * (len(head) - 1)
    tables = ingest.ingest_late(
        cells(
            spark, late_main(2022, "8.ОП користувачів 2022"),
            sheet("n", 2022, "15. Чисельність", 1, [[None], head, [None], species, user, alpha, beta]),
            events_sheet("n", 2022, "13.РОЗСЕЛЕННЯ", 2),
        )
    )
    assert fact_rows(tables["populations"]) == WANT_COUNTS
    assert fact_rows(tables["harvest"]) == WANT_SHOT
    assert rows_of(tables["relocation"], "host", "species", "count", "location", "origin") == WANT_EVENTS
    assert ("Альфа", "area_total", 1.5) in rows_of(tables["hosts_meta"], "host", "metric", "value")
    assert rows_of(tables["finances"].filter("metric = 'expense_breeding'"), "host", "value") == [("Альфа", None), ("Бета", 3.0)]


def latest_cells(spark):
    total, kept = "Чисельність всього, голів", "в неволі"
    census = [[None]] * 3 + [
        [None, None, "лось", None, "кабан", None, "Всього копитних"], [None, None, total, kept, total, kept, total],
        [1, "Альфа", 3, 0, 10, 0, 13], [2, "Бета", 4, 1, None, 0, 4], [3, "Разом", 7, 1, 10, 0, 17],
    ]
    return cells(
        spark, late_main(2025, "8. ОП користувачів 2025"),
        sheet("n", 2025, "Чисельність", 1, census), events_sheet("n", 2025, "13.Розселення", 2),
    )


def test_latest_era(spark):
    tables = ingest.ingest_latest(latest_cells(spark))
    assert fact_rows(tables["populations"]) == WANT_COUNTS
    assert tables["harvest"].count() == 0 and tables["harvest"].columns == ["year", "host", "species", "metric", "value"]
    assert ("Альфа", "area_total", 0.0015) in rows_of(tables["hosts_meta"], "host", "metric", "value")
    assert rows_of(tables["finances"].filter("metric = 'total_expenses'"), "host", "value") == [("Альфа", 7.0), ("Бета", None)]


def test_missing_header_is_an_error(spark):
    grid = cells(spark, sheet("x", 2014, "S", 0, [["a", "b"], ["c", "d"]]))
    with pytest.raises(PySparkException, match="no header row"):
        layout.header_row(grid, "Користувач", col=0, required=True).collect()
    assert layout.header_row(grid, "Користувач", col=0).count() == 0


def late_cells(spark, main="8.ОП користувачів 2022", count="15. Чисельність", log="13.РОЗСЕЛЕННЯ", blank=(), rows=True):
    head, species, alpha, beta = sections_rows()
    head = [None if v in blank else v for v in head]
    user = ["Користувач" if "user" not in blank else None] + [None] * (len(head) - 1)
    first = late_main(2022, main)
    if not rows:
        first = [x for x in first if x[4] <= 2 or x[5] > 0]
    return cells(
        spark, first, sheet("n", 2022, count, 1, [[None], head, [None], species, user, alpha, beta]), events_sheet("n", 2022, log, 2)
    )


INNER = {"count section row", "count header row"}
SECTION_NAMES = {f"{t} section {k}" for t in ("populations", "harvest") for k in ("ungulates", "fur", "birds")}
DAMAGES = [
    ({}, set()),
    ({"main": "8 ОП"}, {"main sheet", "main header row", "main data row"}),
    ({"rows": False}, {"main data row"}),
    ({"count": "15. Облік"}, {"count sheet", *INNER, *SECTION_NAMES}),
    ({"blank": ("Чисельність хутрових",)}, {"populations section fur"}),
    ({"blank": ("Кількість добутих (вилучених) пернатих",)}, {"harvest section birds"}),
    ({"blank": ("Чисельність копитних",)}, {*INNER, *SECTION_NAMES}),
    ({"blank": ("user",)}, {"count header row", *SECTION_NAMES}),
    ({"log": "13"}, {"relocation sheet", "relocation header row"}),
]


@pytest.mark.parametrize(("damage", "want"), DAMAGES)
def test_missing_parts_are_named(spark, damage, want):
    grid = late_cells(spark, **damage)
    assert {(r.file_id, r.period, r.part) for r in ingest.missing_parts(grid, "late").collect()} == {("n", 2022, p) for p in want}


@pytest.mark.parametrize(("damage", "want"), [DAMAGES[0], DAMAGES[1], DAMAGES[6]])
def test_missing_parts_stop_the_ingest(spark, damage, want):
    grid = late_cells(spark, **damage)
    if not want:
        assert fact_rows(ingest.ingest_late(grid)["populations"]) == WANT_COUNTS
        return
    with pytest.raises(ingest.MissingParts, match=f"no {sorted(want)[0]} in n"):
        ingest.ingest_late(grid)
    tables = ingest.ingest_late(grid, missing="skip")
    assert tables["populations"].count() == (0 if "populations section ungulates" in want else 4)
    assert (tables["hosts_meta"].count() > 0) == ("main data row" not in want)


def test_one_damaged_file_among_others(spark):
    """A part that one file lacks doesn't hide in the tables of the others."""
    good, bad = late_cells(spark), late_cells(spark, main="x").withColumn("file_id", F.lit("bad"))
    both = good.unionByName(bad)
    assert {(r.file_id, r.part) for r in ingest.missing_parts(both, "late").collect()} == {
        ("bad", "main sheet"), ("bad", "main header row"), ("bad", "main data row")
    }
    with pytest.raises(ingest.MissingParts, match="in bad"):
        ingest.ingest_late(both)


def test_other_eras_name_what_they_lack(spark):
    early = cells(spark, early_sheet()).withColumn("v", F.when(~F.contains("v", F.lit("Розділ")), F.col("v")))
    assert [r.part for r in ingest.missing_parts(early, "early").collect()] == ["section four"]
    blank = cells(spark, sheet("m", 2014, "2-тп 1", 0, [["Користувач", "x"]]))
    assert {r.part for r in ingest.missing_parts(blank, "middle").collect()} == {"count sheet", "count header row"}
    latest = latest_cells(spark).filter("sheet <> 'Чисельність'")
    assert [r.part for r in ingest.missing_parts(latest, "latest").collect()] == ["count sheet"]
    with pytest.raises(ValueError, match="missing must be"):
        ingest.ingest_latest(latest, missing="drop")


def test_required_operators_name_the_sheet(spark):
    """Also a sheet without a single cell in the column that is searched."""
    grid = cells(
        spark, sheet("a", 1, "S", 0, [["Користувач", "k1", None], ["x", "y", "z"]]),
        [("b", 1, "T", 0, 0, 5, "far away")], sheet("c", 1, "U", 0, [["Користувач", "k1", None], [None, "y", None]]),
    )
    with pytest.raises(PySparkException, match="no header row in b T"):
        layout.header_row(grid, "Користувач", col=0, required=True).collect()
    hdr = layout.header_row(grid, "Користувач", col=0)
    assert rows_of(hdr, "file_id", "hdr_r") == [("a", 0), ("c", 0)]
    with pytest.raises(PySparkException, match="no section in [ac] [SU] two"):
        layout.sections(grid, hdr, {"one": "k1", "two": "k2"}, required=True).collect()
    assert rows_of(layout.sections(grid, hdr, {"one": "k1"}, required=True), "file_id", "c0", "c1") == [("a", 1, 2), ("c", 1, 2)]
    with pytest.raises(PySparkException, match="no data row in c U"):
        layout.first_data_row(grid, hdr, required=True).collect()
    sheets = ingest.sheets_of(grid)
    with pytest.raises(PySparkException, match="no such sheet in [ac]"):
        layout.sheet_by_keyword(sheets, "t", required=True).collect()
    with pytest.raises(PySparkException, match="no such sheet in [ab]"):
        layout.sheet_by_priority(sheets, ["U"], required=True).collect()
    assert rows_of(layout.sheet_by_priority(sheets, ["U", "T", "S"], required=True), "file_id", "sheet") == [("a", "S"), ("b", "T"), ("c", "U")]


def test_final_tables_of_two_eras(spark):
    mapping = spark.createDataFrame([("Альфа", "A"), ("Бета", "SKIP")], "host_raw string, host_canonical string")
    eras = [ingest.ingest_early(cells(spark, early_sheet())), ingest.ingest_latest(latest_cells(spark))]
    built = final.build_all(eras, mapping)
    assert set(built) == {"hosts_meta", "finances", "populations", "harvest", "relocation", "relocation_events"}
    moose = built["populations"].filter("species = 'Лось'")
    assert rows_of(moose, "year", "host_canonical", "species_canonical", "value") == [(2005, "A", "Лось", 3.0), (2025, "A", "Лось", 3.0)]
    assert rows_of(built["relocation_events"], "host_canonical", "count") == [("A", 5.0), ("A", None)]
