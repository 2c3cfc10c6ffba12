"""JSON text columns: parsed or replaced by an empty value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
STRING_MAP = T.MapType(T.StringType(), T.StringType())


def safe_json_list(c: Column) -> Column:
    """Elements of a JSON list as JSON text; empty for anything that is not a list."""
    is_list = F.ltrim(c).startswith("[")
    empty = F.array().cast(STRINGS)
    return F.when(is_list, F.coalesce(F.from_json(c, STRINGS), empty)).otherwise(empty)


def safe_json_object(c: Column) -> Column:
    """Fields of a JSON object as JSON text; empty for anything that is not an object."""
    is_object = F.ltrim(c).startswith("{")
    empty = F.create_map().cast(STRING_MAP)
    return F.when(is_object, F.coalesce(F.from_json(c, STRING_MAP), empty)).otherwise(empty)


def json_structs(c: Column, schema: T.StructType) -> Column:
    """The objects of a JSON list as structs; other elements are skipped."""
    objects = F.filter(safe_json_list(c), lambda e: F.ltrim(e).startswith("{"))
    return F.transform(objects, lambda e: F.from_json(e, schema))
