"""Closed vocabularies of the ontology and the dimension tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The closed sets of the ontology.
ENTITY_TYPES = ["Industry", "ReportingFramework", "Category", "Metric", "Model"]
METRIC_TYPES = ["DirectMetric", "CalculatedMetric", "InputMetric"]
MEASUREMENT_TYPES = ["Quantitative", "Qualitative"]
PREDICATES = ["ReportUsing", "Include", "ConsistOf", "IsCalculatedBy", "RequiresInputFrom"]

# Keys that must be present in the properties of each type.
REQUIRED_PROPERTIES = {
    "Metric": ["measurement_type", "metric_type", "unit", "code", "description"],
    "Model": ["description", "equation", "input_variables"],
    "Category": ["section_title"],
    "ReportingFramework": ["name"],
}

# Edge signatures (subject type, predicate, object type), an optional check.
SIGNATURES = [
    ("Industry", "ReportUsing", "ReportingFramework"),
    ("ReportingFramework", "Include", "Category"),
    ("Category", "ConsistOf", "Metric"),
    ("Metric", "IsCalculatedBy", "Model"),
    ("Model", "RequiresInputFrom", "Metric"),
]


def folded(name: Column) -> Column:
    """A name by its letters and digits alone, letter case aside."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def is_ontology_predicate(predicate: Column) -> Column:
    """Whether a predicate is one of the five, however spelled. NULL is none."""
    return F.coalesce(folded(predicate).isin([p.lower() for p in PREDICATES]), F.lit(False))


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "subject_type string, predicate string, object_type string")
