"""Knowledge-graph views over the extraction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.nested import as_object


def entities(raw: DataFrame) -> DataFrame:
    """Upsert rows with their properties as a VARIANT object.

    ``props_kind``: 'object', 'null' (JSON null), 'other' (a list or scalar) or 'absent' (no text or no
    readable JSON). Only an object has ``props``.
    """
    # parsed once, in a step of its own
    raw = raw.where("op = 'upsert'").select("rec_id", "doc_id", "pos", "id", "type", "label", F.try_parse_json("properties").alias("_v"), "source", "provenance")
    v = F.col("_v")
    kind = F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").when(as_object(v).isNotNull(), "object").otherwise("other")
    return raw.select("rec_id", "doc_id", "pos", "id", "type", "label", as_object(v).alias("props"), kind.alias("props_kind"), "source", "provenance")


def relationships(raw: DataFrame) -> DataFrame:
    return raw.select("rel_id", "doc_id", "pos", "subject", "predicate", "object", "source")


def dedup_entities(ents: DataFrame, key: str = "id") -> DataFrame:
    """Across segments the first row of each key within a document; rows without a key all stay."""
    first = ents.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.min(F.struct("pos", "rec_id")).alias("f"))
    first = first.select(F.col("f.rec_id").alias("rec_id"))
    return ents.join(first, "rec_id", "left_semi").unionByName(ents.where(F.col(key).isNull()))
