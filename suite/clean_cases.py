"""Cleaning functions, filters, entity resolution and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpanel.functions import numbers as N
from gridpanel.functions import text as X
from gridpanel.operators import filters, resolve
from gridpanel.plans import final
from gridpanel.session import shared_path
from gridpanel.sources.facts import scan_mapping, write_table
from suite import views as V
from suite.registry import case
from suite.tables import table

# --- labels ------------------------------------------------------------------------


@case(
    "is_aggregate_basic",
    "SELECT id, contains(lower(s), 'всього') OR contains(lower(s), 'усього') OR contains(lower(s), 'по області') AS flag FROM names",
    ["names"],
)
def _is_aggregate_basic(spark, d):
    return V.names(spark, d).select("id", X.is_aggregate(F.col("s")).alias("flag"))


@case(
    "is_aggregate_ext",
    """SELECT id, contains(lower(s), 'всього') OR contains(lower(s), 'усього') OR contains(lower(s), 'по області')
       OR contains(lower(s), 'разом') OR contains(lower(s), 'в тому числі') OR contains(lower(s), 'у тому числі') AS flag FROM names""",
    ["names"],
)
def _is_aggregate_ext(spark, d):
    return V.names(spark, d).select("id", X.is_aggregate(F.col("s"), extended=True).alias("flag"))


@case(
    "is_contaminant",
    "SELECT doc_id, regexp_matches(text, '[0-9]{10,}') OR contains(lower(text), 'confidential') AS flag FROM documents",
)
def _is_contaminant(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.is_contaminant(F.col("text"), ["Confidential"]).alias("flag"))


TIDY = """replace(replace(trim(regexp_replace(regexp_replace(trim(s), ' {2,}', ' ', 'g'), '[*]+$', '')), '- ', '-'), '"', chr(39))"""


@case(
    "norm_species_v1",
    f"""SELECT id, CASE WHEN t <> 'Інші' AND NOT contains(lower(t), 'всього') AND NOT contains(lower(t), 'усього') THEN t END AS species
        FROM (SELECT id, {TIDY} AS t FROM names) q""",
    ["names"],
)
def _norm_species_v1(spark, d):
    return V.names(spark, d).select("id", X.norm_species_v1(F.col("s")).alias("species"))


@case(
    "norm_species_v2",
    f"""SELECT id, CASE WHEN t <> '' AND n <> 'Інші' AND NOT starts_with(lower(t), 'всього') AND NOT starts_with(lower(t), 'усього')
         AND NOT contains(lower(t), 'в тому числі') AND NOT contains(lower(t), 'у тому числі')
        THEN CASE WHEN ends_with(lower(t), '-всього') OR ends_with(lower(t), '-усього') THEN trim(regexp_replace(n, '-[^-]*$', '')) ELSE n END END AS species
        FROM (SELECT id, t, CASE WHEN concat(upper(t[1]), t[2:]) = 'Байбак' THEN 'Бабак' ELSE concat(upper(t[1]), t[2:]) END AS n
         FROM (SELECT id, {TIDY} AS t FROM names) a) q""",
    ["names"],
)
def _norm_species_v2(spark, d):
    return V.names(spark, d).select("id", X.norm_species_v2(F.col("s")).alias("species"))


@case(
    "species_from_label",
    "SELECT id, trim(CASE WHEN contains(s, ' - ') THEN split_part(s, ' - ', 1) ELSE split_part(s, ' -', 1) END) AS species FROM names",
    ["names"],
)
def _species_from_label(spark, d):
    return V.names(spark, d).select("id", X.species_from_label(F.col("s")).alias("species"))


@case(
    "detect_metric",
    """SELECT id, CASE WHEN contains(lower(name), 'добуто') THEN CASE WHEN contains(lower(unit), 'тонн') THEN 'shot_tons' ELSE 'shot_heads' END
        WHEN contains(lower(name), 'загальна кількість') THEN 'count' WHEN contains(lower(name), 'розселено') THEN 'relocated'
        WHEN contains(lower(name), 'відловлено') THEN 'caught' WHEN contains(lower(name), 'виявлено загиблими') THEN 'found_dead' END AS metric
       FROM row_labels""",
    ["row_labels"],
)
def _detect_metric(spark, d):
    return V.row_labels(spark, d).select("id", X.detect_metric(F.col("name"), F.col("unit")).alias("metric"))


@case(
    "is_species_header",
    "SELECT id, coalesce(trim(code) <> '' AND trim(code) <> 'Код тварини', false) AS flag FROM row_labels",
    ["row_labels"],
)
def _is_species_header(spark, d):
    return V.row_labels(spark, d).select("id", X.is_species_header(F.col("code")).alias("flag"))


@case(
    "is_group_code",
    "SELECT id, coalesce(CAST(try_cast(code AS DOUBLE) AS BIGINT) % 100 = 0, false) AS flag FROM row_labels",
    ["row_labels"],
)
def _is_group_code(spark, d):
    return V.row_labels(spark, d).select("id", X.is_group_code(F.col("code")).alias("flag"))


@case(
    "coerce_numeric",
    "SELECT id, line, CASE WHEN isnan(try_cast(s AS DOUBLE)) THEN NULL ELSE try_cast(s AS DOUBLE) END AS value FROM number_texts",
    ["number_texts"],
)
def _coerce_numeric(spark, d):
    return V.number_texts(spark, d).select("id", "line", N.to_number(F.col("s")).alias("value"))


@case("strip_text", "SELECT c_custkey, c_name AS s FROM customer")
def _strip_text(spark, d):
    padded = F.concat(F.lit("  \t"), F.col("c_name"), F.lit("  \n"))
    return table(spark, d, "customer").select("c_custkey", X.strip_text(padded).alias("s"))


# --- filters and values ------------------------------------------------------------


@case(
    "drop_null_key",
    "SELECT host, species, count FROM event_rows WHERE host IS NOT NULL AND species IS NOT NULL",
    ["event_rows"],
)
def _drop_null_key(spark, d):
    rows = V.event_rows(spark, d).select("host", "species", "count")
    return filters.drop_null_key(rows, ["host", "species"])


@case(
    "filter_panel",
    """SELECT year, host, species, metric, value FROM facts_raw
       WHERE metric = 'count' AND species = 'SMALL' AND year BETWEEN 1996 AND 1999 AND value IS NOT NULL""",
    ["facts_raw"],
)
def _filter_panel(spark, d):
    return filters.filter_panel(V.facts_raw(spark, d), "count", "SMALL", (1996, 1999), with_value=True)


PAIR_SQL = """SELECT host, year, avg(value) FILTER (metric = 'count') AS population, avg(value) FILTER (metric = 'shot_heads') AS shot_heads
 FROM panel WHERE species = 'SMALL' GROUP BY host, year"""


def _pairs(spark, d):
    small = V.panel(spark, d).filter("species = 'SMALL'")
    mean = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    return small.groupBy("host", "year").agg(mean("count"), mean("shot_heads")).withColumnRenamed("count", "population")


@case(
    "drop_incomplete",
    f"SELECT * FROM ({PAIR_SQL}) t WHERE population > 0 AND shot_heads IS NOT NULL",
    ["panel"],
    ["population", "shot_heads"],
)
def _drop_incomplete(spark, d):
    return filters.drop_incomplete(_pairs(spark, d), ["population", "shot_heads"], positive=["population"])


@case(
    "fill_missing",
    f"SELECT host, year, coalesce(population, 0) AS population, coalesce(shot_heads, 0) AS shot_heads FROM ({PAIR_SQL}) t",
    ["panel"],
    ["population", "shot_heads"],
)
def _fill_missing(spark, d):
    return filters.fill_missing(_pairs(spark, d), ["population", "shot_heads"])


@case(
    "ratio_and_label",
    f"""SELECT host, year, shot_heads / nullif(population, 0) AS harvest_rate, CAST(shot_heads / nullif(population, 0) >= 1.15 AS INT) AS label
        FROM ({PAIR_SQL}) t WHERE population > 0 AND shot_heads IS NOT NULL""",
    ["panel"],
    ["harvest_rate"],
)
def _ratio_and_label(spark, d):
    rate = N.ratio(F.col("shot_heads"), F.col("population"))
    pairs = filters.drop_incomplete(_pairs(spark, d), ["population", "shot_heads"], positive=["population"])
    return pairs.select("host", "year", rate.alias("harvest_rate"), N.rate_label(rate, 1.15).alias("label"))


UNIT_RULES = (("total_expenses", 2000, 2001, 1000.0), ("expense_feeding", 2001, 2001, 1000.0))


@case(
    "rescale_units",
    """SELECT year, host, metric, value / CASE WHEN metric = 'total_expenses' AND year BETWEEN 2000 AND 2001 THEN 1000.0
        WHEN metric = 'expense_feeding' AND year = 2001 THEN 1000.0 ELSE 1.0 END AS value FROM fin_raw""",
    ["fin_raw"],
    ["value"],
)
def _rescale_units(spark, d):
    return filters.rescale_units(V.fin_raw(spark, d), UNIT_RULES)


@case(
    "exclude_entities",
    "SELECT * FROM panel WHERE host NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 50 = 7)",
    ["panel"],
    ["value"],
)
def _exclude_entities(spark, d):
    return filters.exclude_entities(V.panel(spark, d), excluded_hosts(spark, d))


def excluded_hosts(spark, d):
    return table(spark, d, "supplier").filter("s_suppkey % 50 = 7").select(F.col("s_name").alias("host"))


@case(
    "round_report",
    "SELECT host, year, species, metric, round_even(value, 1) AS r1, round_even(value, 3) AS r3 FROM panel",
    ["panel"],
)
def _round_report(spark, d):
    value = F.col("value")
    return V.panel(spark, d).select(
        "host", "year", "species", "metric", N.round_report(value, 1).alias("r1"), N.round_report(value, 3).alias("r3")
    )


# --- resolution --------------------------------------------------------------------

RESOLVED = "facts_raw f LEFT JOIN host_map m ON f.host = m.host_raw"


@case(
    "resolve_entity",
    f"SELECT f.host, m.host_canonical, count(*) AS n FROM {RESOLVED} GROUP BY 1, 2",
    ["facts_raw", "host_map"],
)
def _resolve_entity(spark, d):
    out = resolve.resolve_entity(V.facts_raw(spark, d), V.host_map(spark, d))
    return out.groupBy("host", "host_canonical").agg(F.count(F.lit(1)).alias("n"))


@case(
    "resolve_trimmed",
    """SELECT f.host, coalesce(m.host_canonical, t.c) AS host_canonical, f.n
       FROM (SELECT concat(host, '  ') AS host, count(*) AS n FROM facts_raw GROUP BY 1) f
       LEFT JOIN host_map m ON f.host = m.host_raw
       LEFT JOIN (SELECT trim(host_raw) AS k, min(host_canonical) AS c FROM host_map GROUP BY 1) t ON trim(f.host) = t.k""",
    ["facts_raw", "host_map"],
)
def _resolve_trimmed(spark, d):
    facts = V.facts_raw(spark, d).withColumn("host", F.concat("host", F.lit("  ")))
    counts = resolve.spelling_counts(facts)
    return resolve.resolve_entity(counts, V.host_map(spark, d), trim_fallback=True).select("host", "host_canonical", "n")


@case(
    "drop_unresolved",
    f"""SELECT f.year, f.host, f.species, f.metric, f.value, m.host_canonical FROM {RESOLVED}
        WHERE m.host_canonical IS NOT NULL AND m.host_canonical <> 'SKIP'""",
    ["facts_raw", "host_map"],
)
def _drop_unresolved(spark, d):
    out = resolve.drop_unresolved(resolve.resolve_entity(V.facts_raw(spark, d), V.host_map(spark, d)))
    return out.select("year", "host", "species", "metric", "value", "host_canonical")


@case(
    "audit_resolution",
    f"""SELECT count(*) AS before, count(*) FILTER (m.host_canonical <> 'SKIP') AS after,
        count(*) - count(*) FILTER (m.host_canonical <> 'SKIP') AS removed FROM {RESOLVED}""",
    ["facts_raw", "host_map"],
)
def _audit_resolution(spark, d):
    return resolve.audit_resolution(V.facts_raw(spark, d), V.host_map(spark, d))


@case(
    "audit_unresolved",
    f"SELECT f.host, count(*) AS n FROM {RESOLVED} WHERE m.host_raw IS NULL GROUP BY 1",
    ["facts_raw", "host_map"],
)
def _audit_unresolved(spark, d):
    return resolve.audit_unresolved(V.facts_raw(spark, d), V.host_map(spark, d))


SYNONYMS = {"SMALL": "MINI", "ECONOMY": "STANDARD"}


@case(
    "map_species",
    """SELECT species, CASE trim(species) WHEN 'SMALL' THEN 'MINI' WHEN 'ECONOMY' THEN 'STANDARD' ELSE trim(species) END AS species_canonical,
       count(*) AS n FROM (SELECT CASE WHEN value IS NOT NULL THEN concat(species, ' ') END AS species FROM facts_raw) f GROUP BY 1, 2""",
    ["facts_raw"],
)
def _map_species(spark, d):
    dirty = F.when(F.col("value").isNotNull(), F.concat("species", F.lit(" ")))
    facts = resolve.map_species(V.facts_raw(spark, d).withColumn("species", dirty), SYNONYMS)
    return facts.groupBy("species", "species_canonical").agg(F.count(F.lit(1)).alias("n"))


UNION_SQL = """SELECT year, host, metric, CAST(NULL AS VARCHAR) AS species, value FROM fin_raw
 UNION ALL SELECT year, host, metric, species, value FROM facts_raw"""


@case("union_eras", UNION_SQL, ["fin_raw", "facts_raw"])
def _union_eras(spark, d):
    out = resolve.union_eras([V.fin_raw(spark, d), V.facts_raw(spark, d)])
    return out.select("year", "host", "metric", "species", "value")


@case(
    "build_final",
    f"""SELECT f.year, f.host, f.species, f.metric, f.value, m.host_canonical,
         CASE f.species WHEN 'SMALL' THEN 'MINI' WHEN 'ECONOMY' THEN 'STANDARD' ELSE f.species END AS species_canonical
        FROM {RESOLVED} WHERE m.host_canonical IS NOT NULL AND m.host_canonical <> 'SKIP'""",
    ["facts_raw", "host_map"],
)
def _build_final(spark, d):
    facts = V.facts_raw(spark, d)
    eras = [facts.filter("year <= 1997"), facts.filter("year BETWEEN 1998 AND 1999"), facts.filter("year >= 2000")]
    out = final.build_final(eras, V.host_map(spark, d), SYNONYMS)
    return out.select("year", "host", "species", "metric", "value", "host_canonical", "species_canonical")


@case(
    "resolve_mean",
    "SELECT host, year, species, metric, value FROM panel",
    ["panel"],
    ["value"],
)
def _resolve_mean(spark, d):
    return resolve.resolve_mean(V.facts_raw(spark, d), V.host_map(spark, d), ["year", "species", "metric"])


@case(
    "mapping_cardinality",
    "SELECT count(host_raw) AS n_raw, count(DISTINCT host_canonical) AS n_canonical FROM host_map",
    ["host_map"],
)
def _mapping_cardinality(spark, d):
    return resolve.mapping_cardinality(V.host_map(spark, d))


# A mapping file with a further column and a later line for every third spelling.
ORDERED_MAP = """SELECT host_raw, host_canonical AS first_choice, host_canonical AS host_canonical_draft, 0 AS line FROM host_map
 UNION ALL SELECT host_raw, host_canonical, concat('Later ', host_canonical), 1 FROM host_map WHERE length(host_raw) % 3 = 0"""
LAST_MAP = f"SELECT host_raw, max_by(host_canonical_draft, line) AS host_canonical FROM ({ORDERED_MAP}) o GROUP BY 1"


def _mapping_file(spark, d):
    """The mapping written as one CSV file, its repeated entries below the first ones."""
    path = shared_path(spark, "mapping")
    base = V.host_map(spark, d).select("host_raw", F.col("host_canonical").alias("first_choice"), F.col("host_canonical").alias("host_canonical_draft"))
    later = base.filter(F.char_length("host_raw") % 3 == 0).withColumn("host_canonical_draft", F.concat(F.lit("Later "), "first_choice"))
    rows = base.withColumn("line", F.lit(0)).unionByName(later.withColumn("line", F.lit(1)))
    rows = rows.coalesce(1).sortWithinPartitions("line", "host_raw").drop("line")  # a dictionary file, as it is delivered
    write_table(rows, path, partition_by=(), fmt="csv")
    return scan_mapping(spark, path)


@case(
    "mapping_last_wins",
    f"SELECT f.host, f.n, m.host_canonical FROM (SELECT host, count(*) AS n FROM facts_raw GROUP BY 1) f LEFT JOIN ({LAST_MAP}) m ON f.host = m.host_raw",
    ["facts_raw", "host_map"],
)
def _mapping_last_wins(spark, d):
    return resolve.resolve_entity(resolve.spelling_counts(V.facts_raw(spark, d)), _mapping_file(spark, d))


@case(
    "entity_profile_ordered",
    f"""SELECT f.host, m.host_canonical, g.group_size, f.first_year, f.last_year, f.n_years
       FROM (SELECT host, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years FROM facts_raw GROUP BY 1) f
       JOIN ({LAST_MAP}) m ON f.host = m.host_raw
       JOIN (SELECT host_canonical, count(*) AS group_size FROM ({LAST_MAP}) k GROUP BY 1) g ON m.host_canonical = g.host_canonical""",
    ["facts_raw", "host_map"],
)
def _entity_profile_ordered(spark, d):
    return resolve.entity_profile(V.facts_raw(spark, d), _mapping_file(spark, d))


@case(
    "entity_profile",
    """SELECT f.host, m.host_canonical, g.group_size, f.first_year, f.last_year, f.n_years
       FROM (SELECT host, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years FROM facts_raw GROUP BY 1) f
       JOIN host_map m ON f.host = m.host_raw
       JOIN (SELECT host_canonical, count(*) AS group_size FROM host_map GROUP BY 1) g ON m.host_canonical = g.host_canonical""",
    ["facts_raw", "host_map"],
)
def _entity_profile(spark, d):
    return resolve.entity_profile(V.facts_raw(spark, d), V.host_map(spark, d))


@case(
    "table_summary",
    """SELECT metric, count(*) AS n_rows, count(DISTINCT host) AS n_hosts, count(DISTINCT species) AS n_species,
       sum(value) FILTER (species = 'SMALL') AS focal_total FROM facts_raw GROUP BY 1""",
    ["facts_raw"],
    ["focal_total"],
)
def _table_summary(spark, d):
    out = resolve.table_summary(V.facts_raw(spark, d), "SMALL")
    return out.withColumn("n_rows", F.col("n_rows").cast("bigint"))


@case(
    "null_profile",
    """SELECT metric, count(value) AS valid, count(*) - count(value) AS nulls, (count(*) - count(value)) * 100.0 / count(*) AS null_pct
       FROM facts_raw GROUP BY 1""",
    ["facts_raw"],
    ["null_pct"],
)
def _null_profile(spark, d):
    return resolve.null_profile(V.facts_raw(spark, d))
