"""From era tables to the clean analytical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.numbers import to_number
from gridpanel.operators.resolve import (
    SKIP,
    SPECIES_SYNONYMS,
    drop_unresolved,
    map_species,
    resolve_entity,
    union_eras,
)
from gridpanel.plans.ingest import Tables
from gridpanel.sources.facts import write_table


def build_final(
    parts: Sequence[DataFrame],
    mapping: DataFrame,
    synonyms: DataFrame | Mapping[str, str] = SPECIES_SYNONYMS,
    value: str = "value",
    skip: str = SKIP,
    trim_fallback: bool = False,
) -> DataFrame:
    """Union the eras, resolve entities, drop the unresolved, canonicalise species, coerce values."""
    facts = union_eras(parts)
    known = drop_unresolved(resolve_entity(facts, mapping, trim_fallback=trim_fallback), skip)
    return map_species(known, synonyms).withColumn(value, to_number(F.col(value)))


def build_all(eras: Sequence[Tables], mapping: DataFrame, **options) -> Tables:
    """The four long tables of all eras, and the event log of the later ones.

    Early relocation rows (metric form) and the event log are different tables;
    frames with a ``count`` column are events.
    """
    out: Tables = {}
    for table in ("hosts_meta", "finances", "populations", "harvest"):
        out[table] = build_final([era[table] for era in eras if table in era], mapping, **options)
    logs = [era["relocation"] for era in eras if "count" in era["relocation"].columns]
    early = [era["relocation"] for era in eras if "count" not in era["relocation"].columns]
    if early:
        out["relocation"] = build_final(early, mapping, **options)
    if logs:
        out["relocation_events"] = build_final(logs, mapping, value="count", **options)
    return out


def write_final(tables: Tables, folder: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}_final")
