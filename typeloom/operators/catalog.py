"""Catalogues of logical types and semantic tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import logical_types as L
from ..plans.registry import TypeSystem, type_system


def list_logical_types(spark: SparkSession, system: TypeSystem | None = None) -> DataFrame:
    """name, type_string, description, physical_type, standard_tags, is_default_type, is_registered, parent_type; by name."""
    system = system or type_system
    known = {*L.all_types(), *system.types}
    rows = [
        (t.__name__, t.type_string(), (t.__doc__ or "").split("\n")[0], t.physical.simpleString(), sorted(t.standard_tags), t is system.default_type, t in system.types, p.__name__ if (p := system.parent(t)) else None)
        for t in sorted(known, key=lambda t: t.__name__)
    ]
    return spark.createDataFrame(rows, "name string, type_string string, description string, physical_type string, standard_tags array<string>, is_default_type boolean, is_registered boolean, parent_type string")


def list_semantic_tags(spark: SparkSession, system: TypeSystem | None = None) -> DataFrame:
    """name, is_standard, valid_logical_types."""
    system = system or type_system
    rows = [(tag, True, sorted(t.__name__ for t in system.types if tag in t.standard_tags)) for tag in ("numeric", "category")]
    numeric = sorted(t.__name__ for t in system.types if "numeric" in t.standard_tags)
    rows += [("index", False, None), ("time_index", False, sorted(["Datetime", *numeric])), ("date_of_birth", False, ["Datetime"]), ("ignore", False, None), ("passthrough", False, None)]
    return spark.createDataFrame(rows, "name string, is_standard boolean, valid_logical_types array<string>")


def valid_mi_types() -> list[type[L.LogicalType]]:
    return [t for t in L.all_types() if t.standard_tags & {"category", "numeric"} or t in (L.Datetime, L.Boolean, L.BooleanNullable)]


def valid_pearson_types() -> list[type[L.LogicalType]]:
    return [t for t in L.all_types() if "numeric" in t.standard_tags or t is L.Datetime]


def valid_spearman_types() -> list[type[L.LogicalType]]:
    return [t for t in L.all_types() if "numeric" in t.standard_tags or t in (L.Datetime, L.Ordinal)]
