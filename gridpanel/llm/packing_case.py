"""The packing query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridpanel.llm import packing
from gridpanel.llm.common import read
from gridpanel.llm.registry import query


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
