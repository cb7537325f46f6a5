from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
import pytest

from gridpanel import schemas
from gridpanel.operators import resolve
from gridpanel.session import materialize, shared_folder, shared_path
from gridpanel.sources import cells as C
from gridpanel.sources import facts as S
from gridpanel.streaming.arrivals import append_final, arriving_facts
from tests.grids import rows_of


def small(spark):
    rows = [(2000, 'ДП "Х"', "Лось", "count", 1.5), (2001, "Б, інше", None, "count", None)]
    return spark.createDataFrame(rows, schemas.SPECIES_FACT)


def test_csv_round_trip(spark):
    path = shared_path(spark, "csv")
    S.write_table(small(spark), path, partition_by=(), fmt="csv")
    assert rows_of(S.scan_fact_csv(spark, path, schemas.SPECIES_FACT), "year", "host", "species", "value") == rows_of(
        small(spark), "year", "host", "species", "value"
    )


def put(spark, name, *files):
    """A folder with the given texts as files, written by Spark's own file system."""
    folder = shared_path(spark, name)
    os.makedirs(folder)
    for i, text in enumerate(files):
        with open(f"{folder}/f{i}.csv", "w", encoding="utf-8", newline="") as file:
            file.write(text)
    return folder


def test_csv_columns_are_bound_by_name(spark):
    folder = put(
        spark, "named",
        "year,host,species,metric,value\n2000,A,Лось,count,1.5\n",
        "host,value,note,year,metric\nB,2,x,2001,count\n",
        '\ufeffvalue,"host",year\n3,"C, c",2002\n',
        "",
        "host,year\n",
    )
    got = S.scan_fact_csv(spark, folder, schemas.SPECIES_FACT, required=["host", "year"])
    assert got.schema == schemas.SPECIES_FACT
    assert rows_of(got, "year", "host", "species", "metric", "value") == [
        (2000, "A", "Лось", "count", 1.5), (2001, "B", None, "count", 2.0), (2002, "C, c", None, None, 3.0)
    ]
    found = {(r.file[-6:-4], r.column, r.position, r.status) for r in S.csv_columns(spark, folder, schemas.SPECIES_FACT).collect()}
    assert {("f1", "note", 2, "unknown"), ("f1", "species", None, "absent"), ("f2", "value", 0, "present"), ("f3", None, None, "empty")} <= found
    assert sum(s == "absent" for *_, s in found) == 6
    with pytest.raises(S.MissingColumns, match="f4.csv: no column value"):
        S.scan_fact_csv(spark, folder, schemas.SPECIES_FACT, required=["value"])
    assert S.scan_fact_csv(spark, f"{folder}/none*", schemas.SPECIES_FACT).count() == 0
    twice = put(spark, "twice", "year,host,host\n1,a,b\n")
    with pytest.raises(S.MissingColumns, match="column host twice"):
        S.scan_fact_csv(spark, twice, schemas.SPECIES_FACT)


def test_blanks_in_csv_survive(spark):
    path = shared_path(spark, "blanks")
    rows = spark.createDataFrame([(1, " A ", "m", 1.0)], schemas.ENTITY_FACT)
    S.write_table(rows, path, partition_by=(), fmt="csv")
    assert rows_of(S.scan_fact_csv(spark, path, schemas.ENTITY_FACT), "host") == [(" A ",)]


def test_compressed_headers(spark):
    path = shared_path(spark, "gz")
    small(spark).select("value", "host", "year").write.option("header", True).option("compression", "gzip").csv(path)
    assert rows_of(S.scan_fact_csv(spark, path, schemas.SPECIES_FACT), "year", "value") == [(2000, 1.5), (2001, None)]


def test_mapping_file_with_repeated_entries(spark):
    """Read by name, in file order, and the last entry wins everywhere."""
    text = "n,host_canonical_draft,host_raw\n1,X,a\n2,Y,b \n3,Z,a\n4,SKIP,c\n5,W, b\n"
    mapping = S.scan_mapping(spark, put(spark, "mapping", text))
    lookup = resolve.lookup_table(mapping, "host_raw", "host_canonical")
    assert rows_of(lookup, "host_raw", "host_canonical") == [(" b", "W"), ("a", "Z"), ("b ", "Y"), ("c", "SKIP")]
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "host string, year int")
    assert rows_of(resolve.resolve_entity(facts, mapping), "host", "host_canonical") == [("a", "Z"), ("b", None), ("c", "SKIP"), ("d", None)]
    assert rows_of(resolve.resolve_entity(facts, mapping, trim_fallback=True), "host", "host_canonical") == [
        ("a", "Z"), ("b", "W"), ("c", "SKIP"), ("d", None)
    ]
    assert rows_of(resolve.entity_profile(facts, mapping), "host", "host_canonical", "group_size") == [("a", "Z", 1), ("c", "SKIP", 1)]
    assert tuple(resolve.mapping_cardinality(mapping).first()) == (4, 4)
    with pytest.raises(S.MissingColumns, match="no column host_canonical_draft"):
        S.scan_mapping(spark, put(spark, "mapping", "host_raw,other\na,b\n"))


def test_order_of_a_long_mapping(spark):
    """Entries stay in file order across the file's splits."""
    lines = [f"k{i % 700},v{i}" for i in range(4000)]
    folder = put(spark, "long", "host_raw,host_canonical_draft\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        mapping = S.scan_mapping(spark, folder)
        assert mapping.rdd.getNumPartitions() > 3
        got = {r.host_raw: r.host_canonical for r in resolve.lookup_table(mapping, "host_raw", "host_canonical").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(line.split(",") for line in lines)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_eras_are_found_and_missing_ones_ignored(spark, fmt):
    folder = shared_path(spark, "eras")
    S.write_table(small(spark), f"{folder}/harvest", partition_by=(), fmt=fmt)
    S.write_table(small(spark), f"{folder}/harvest_2025", partition_by=(), fmt=fmt)
    found = S.scan_many_eras(spark, folder, "harvest", schemas.SPECIES_FACT, fmt)
    assert {r["era"]: r["count"] for r in found.groupBy("era").count().collect()} == {"early": 2, "latest": 2}
    assert S.scan_many_eras(spark, folder, "absent", schemas.SPECIES_FACT, fmt).count() == 0


def test_partitioned_write_prunes(spark):
    path = shared_path(spark, "table")
    S.write_table(small(spark), path)
    back = spark.read.schema(schemas.SPECIES_FACT).parquet(path)
    assert sorted(n for n in os.listdir(path) if n.startswith("year")) == ["year=2000", "year=2001"]
    plan = back.filter("year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and back.filter("year = 2001").count() == 1


def test_files_follow_from_the_size_not_from_tasks(spark):
    """Cells in many tasks and periods: few files, and ranges that don't overlap within a period."""
    rows = [(f"F{y}{f}", y, s, 0, r, c, f"{r}") for y in range(2000, 2008) for f in "ab" for s in ("S", "T") for r in range(40) for c in range(3)]
    cells = spark.createDataFrame(rows, schemas.CELLS).repartition(13)
    path = shared_path(spark, "cells")
    C.write_cells(cells, path)
    files = sorted(glob.glob(f"{path}/period=*/*.parquet"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 8 <= len(files) <= 8 + partitions
    back = C.scan_cells(spark, path)
    assert back.count() == len(rows) and back.exceptAll(cells.select(back.columns)).count() == 0
    spans = {}
    for name in files:
        table = pq.read_table(name, columns=["file_id", "sheet", "r", "c"]).to_pylist()
        keys = [tuple(x.values()) for x in table]
        assert keys == sorted(keys)
        spans.setdefault(os.path.dirname(name), []).append((keys[0], keys[-1]))
    for own in spans.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_row_groups_of_other_sheets_are_skipped(spark):
    rows = [(f"F{f:03}", 2000, "S", 0, r, 0, "x" * 50) for f in range(200) for r in range(200)]
    path = shared_path(spark, "cells")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        C.write_cells(spark.createDataFrame(rows, schemas.CELLS).repartition(6), path)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    hit = total = 0
    for name in glob.glob(f"{path}/period=*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        column = meta.schema.names.index("file_id")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            total += 1
            hit += stats.min <= "F100" <= stats.max
    assert total >= 4 and hit <= 2
    one = C.scan_cells(spark, path).filter("file_id = 'F100'")
    assert "EqualTo(file_id,F100)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 200


def test_materialized_frames_keep_their_rows(spark):
    assert rows_of(materialize(small(spark)), "year", "value") == rows_of(small(spark), "year", "value")
    assert shared_folder(spark) == shared_folder(spark)


def test_arriving_files_are_cleaned_once(spark):
    inbox, out, mark = (shared_path(spark, n) for n in ("inbox", "out", "mark"))
    mapping = spark.createDataFrame([('ДП "Х"', "Х"), ("Б, інше", "SKIP")], schemas.MAPPING)
    S.write_table(small(spark), f"{inbox}", partition_by=(), fmt="csv")
    for expected in (1, 1):
        query = append_final(arriving_facts(spark, inbox, schemas.SPECIES_FACT), mapping, out, mark)
        query.awaitTermination(120)
        assert spark.read.parquet(out).count() == expected
