"""Entity resolution, species canonicalisation and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions import exact
from gridpanel.functions.text import strip_text

SKIP = "SKIP"

# Species spellings and the canonical name each one stands for.
SPECIES_SYNONYMS = {
    "Ведмідь": "Ведмідь бурий",
    "Лебеді": "Лебідь",
    "Олень благ.": "Олень благородний",
    "Олень плям.": "Олень плямистий",
    "Олень європ.": "Олень європейський",
    "Фазани": "Фазан",
    "Дикий кролик": "Кріль дикий",
    "Норка вільна": "Норка європейська",
    "Качка": "Качки",
    "Крижень": "Качки",
    "Байбак": "Бабак",
    "Єноиовидний собака": "Єнотовидний собака",
    "Бобер": "Бобер річковий",
    "Лиска": "Лиска",
    "Гуска сіра": "Гуси",
    "Гуменник": "Гуси",
    "Чирянка мала(чирок свистунок)": "Качки",
    "Нерозень (сіра качка)": "Качки",
}


def lookup_table(mapping: DataFrame, key: str, value: str, position: str = "position") -> DataFrame:
    """(key, value) with one row per key, so that a join on it never multiplies rows.

    With a column ``position``, such as ``scan_mapping`` adds, the mapping is an ordered
    dictionary: of several entries for a key the last one wins, also if it is NULL. Without it
    entries that agree count once, and entries that contradict each other raise an error naming
    the key, because rows have no order in which one could win.
    """
    if position in mapping.columns:
        last = F.max(F.struct(F.col(position).alias("at"), F.col(value).alias("v"))).alias("last")
        return mapping.groupBy(key).agg(last).select(key, F.col("last.v").alias(value))
    clash = F.raise_error(F.concat(F.lit("contradicting entries for "), F.col(key).cast("string"))).cast("string")
    one = F.when(F.min(value).eqNullSafe(F.max(value)), F.min(value)).otherwise(clash)
    return mapping.groupBy(key).agg(one.alias(value))


def resolve_entity(df: DataFrame, mapping: DataFrame, host: str = "host", trim_fallback: bool = False) -> DataFrame:
    """Add ``host_canonical``; the raw spelling is matched exactly, untrimmed.

    No broadcast is forced: the mapping grows with the number of spellings, so
    Spark broadcasts it while its size allows and otherwise sort-merges with
    skew splitting. ``trim_fallback`` retries unmatched names on trimmed keys; spellings that
    are one after trimming follow the same rule as repeated ones (see ``lookup_table``).
    """
    keys = lookup_table(mapping, "host_raw", "host_canonical").withColumnRenamed("host_raw", host)
    out = df.join(keys, host, "left")
    if not trim_fallback:
        return out
    cleaned = mapping.withColumn("_key", strip_text(F.col("host_raw")))
    trimmed = lookup_table(cleaned, "_key", "host_canonical").withColumnRenamed("host_canonical", "_canon")
    retry = F.when(F.col("host_canonical").isNull(), strip_text(F.col(host)))
    out = out.withColumn("_key", retry).join(trimmed, "_key", "left")
    return out.withColumn("host_canonical", F.coalesce("host_canonical", "_canon")).drop("_key", "_canon")


def drop_unresolved(df: DataFrame, skip: str = SKIP) -> DataFrame:
    """Remove unmapped entities and those mapped to the skip marker."""
    return df.filter(F.col("host_canonical").isNotNull() & (F.col("host_canonical") != skip))


def spelling_counts(df: DataFrame, host: str = "host") -> DataFrame:
    """Rows per raw spelling: combined map-side, so a dominant spelling is one row per task."""
    return df.groupBy(host).agg(F.count(F.lit(1)).alias("n"))


def audit_resolution(df: DataFrame, mapping: DataFrame, skip: str = SKIP) -> DataFrame:
    """Rows before, kept and removed; facts are reduced to spelling counts before the join."""
    counted = resolve_entity(spelling_counts(df), mapping)
    kept = F.col("host_canonical").isNotNull() & (F.col("host_canonical") != skip)
    totals = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("after"),
    )
    return totals.withColumn("removed", F.col("before") - F.col("after"))


def audit_unresolved(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spellings with no mapping at all, with their row counts."""
    known = mapping.select(F.col("host_raw").alias("host"))
    return spelling_counts(df).join(known, "host", "left_anti")


def map_species(
    df: DataFrame, synonyms: DataFrame | Mapping[str, str] = SPECIES_SYNONYMS, species: str = "species"
) -> DataFrame:
    """Add ``species_canonical``: synonym, else the trimmed name; NULL stays NULL.

    Frames without a species column pass through. ``synonyms`` may be a table
    ``(raw, canonical)`` instead of the built-in values.
    """
    if species not in df.columns:
        return df
    trimmed = strip_text(F.col(species))
    if isinstance(synonyms, DataFrame):
        table = lookup_table(synonyms, "raw", "canonical").toDF("_trimmed", "_canon")
        joined = df.withColumn("_trimmed", trimmed).join(table, "_trimmed", "left")
        return joined.withColumn("species_canonical", F.coalesce("_canon", "_trimmed")).drop("_trimmed", "_canon")
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(synonyms.items())])
    return df.withColumn("species_canonical", F.coalesce(F.try_element_at(lookup, trimmed), trimmed))


def resolve_mean(facts: DataFrame, mapping: DataFrame, keys: Sequence[str], skip: str = SKIP) -> DataFrame:
    """Mean per canonical entity and ``keys``, with the mapping joined *after* a first
    aggregation on raw spellings: what is shuffled and joined is one row per key, not
    one per fact, and a hot entity has been combined on the map side. The parts that are
    added up are integers, so merging them twice costs no accuracy."""
    keys = list(keys)
    whole, fraction = exact.parts(F.col("value"))
    parts = facts.groupBy("host", *keys).agg(F.sum(whole).alias("_w"), F.sum(fraction).alias("_f"), F.count("value").alias("_n"))
    known = drop_unresolved(resolve_entity(parts, mapping), skip)
    total = known.groupBy(F.col("host_canonical").alias("host"), *keys).agg(
        exact.joined(F.sum("_w"), F.sum("_f")).alias("_s"), F.sum("_n").alias("_n")
    )
    return total.select("host", *keys, F.try_divide("_s", "_n").alias("value"))


def union_eras(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate era tables by column name; absent columns become NULL."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def mapping_cardinality(mapping: DataFrame) -> DataFrame:
    """Distinct raw spellings and distinct entities they stand for."""
    return lookup_table(mapping, "host_raw", "host_canonical").agg(
        F.count("host_raw").alias("n_raw"), F.countDistinct("host_canonical").alias("n_canonical")
    )


def entity_profile(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per raw spelling: first and last year, distinct years, and how many spellings
    share its canonical entity. A spelling listed several times counts once."""
    years = facts.select("host", "year").distinct().groupBy("host").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("year").alias("n_years")
    )
    entries = lookup_table(mapping, "host_raw", "host_canonical").filter("host_canonical IS NOT NULL")
    sizes = entries.groupBy("host_canonical").agg(F.count(F.lit(1)).alias("group_size"))
    named = entries.join(sizes, "host_canonical").withColumnRenamed("host_raw", "host")
    return named.join(years, "host").select(
        "host", "host_canonical", "group_size", "first_year", "last_year", "n_years"
    )


def table_summary(facts: DataFrame, focal: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Rows, distinct entities and species, and the focal species' total, per table.

    Facts are first reduced to one row per (table, host, species).
    """
    cells = facts.groupBy(*by, "host", "species").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v")
    )
    return cells.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.countDistinct("host").alias("n_hosts"),
        F.countDistinct("species").alias("n_species"),
        F.sum(F.when(F.col("species") == focal, F.col("_v"))).alias("focal_total"),
    )


def null_profile(facts: DataFrame, by: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Valid values, nulls and the null share per table."""
    counted = facts.groupBy(*by).agg(F.count(value).alias("valid"), F.count(F.lit(1)).alias("_all"))
    nulls = F.col("_all") - F.col("valid")
    return counted.select(*by, "valid", nulls.alias("nulls"), (F.try_divide(nulls, "_all") * 100).alias("null_pct"))
