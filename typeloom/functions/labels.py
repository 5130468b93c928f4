"""Label sets as keys, and the names of value types in the two export formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_SEP = ":"

# Names of value types in the exported documents.
PG_TYPE_NAMES = {
    "string": "STRING",
    "int": "INT",
    "int32": "INT32",
    "integer": "INTEGER",
    "date": "DATE",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}
XSD_TYPE_NAMES = {
    "string": "xs:string",
    "int": "xs:integer",
    "int32": "xs:integer",
    "integer": "xs:integer",
    "date": "xs:date",
    "double": "xs:double",
    "boolean": "xs:boolean",
}


def label_key(labels: Column) -> Column:
    """All labels of an element as one token; no label gives ``''``."""
    return F.coalesce(F.array_join(F.sort_array(labels), LABEL_SEP), F.lit(""))


def clean_set(items: Column) -> Column:
    """Sorted distinct non-empty items; NULL gives an empty array."""
    kept = F.array_except(items, F.array(F.lit(None).cast("string"), F.lit("")))
    sorted_set = F.coalesce(F.sort_array(kept), F.array().cast("array<string>"))
    # most elements have no label or one: then there is nothing to sort
    one = (F.size(items) == 1) & (F.coalesce(F.get(items, F.lit(0)), F.lit("")) != "")
    return F.when((F.size(items) == 0) | one, items).otherwise(sorted_set)


def _type_name(dtype: Column, names: dict[str, str], default: str) -> Column:
    key = F.lower(F.trim(dtype))
    out = F.lit(default)
    for name, exported in names.items():
        out = F.when(key == name, exported).otherwise(out)
    return out


def pg_type(dtype: Column) -> Column:
    return _type_name(dtype, PG_TYPE_NAMES, "STRING")


def xsd_type(dtype: Column) -> Column:
    return _type_name(dtype, XSD_TYPE_NAMES, "xs:string")
