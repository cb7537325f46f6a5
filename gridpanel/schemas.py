"""Table shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# One row per cell of the used rectangle of a sheet; a blank cell has v = NULL.
CELLS = _struct(file_id=STRING, period=INT, sheet=STRING, sheet_ord=INT, r=LONG, c=INT, v=STRING)

# Entity-level metric fact (finances, entity attributes).
ENTITY_FACT = _struct(year=INT, host=STRING, metric=STRING, value=DOUBLE)

# Entity x species metric fact (counts, harvest, early relocation).
SPECIES_FACT = _struct(year=INT, host=STRING, species=STRING, metric=STRING, value=DOUBLE)

# Relocation event log of the later eras.
EVENTS = _struct(year=INT, host=STRING, species=STRING, count=DOUBLE, location=STRING, origin=STRING)

# Raw spelling -> canonical entity.
MAPPING = _struct(host_raw=STRING, host_canonical=STRING)
