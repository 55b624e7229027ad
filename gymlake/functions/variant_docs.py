"""Documents whose fields drift in type, read through VARIANT.

``from_json`` reads a document against one schema: a field of another type can cost its
neighbours (a nutrient whose id is text nulls the whole nutrient list).  Here the text becomes a
VARIANT first and each field is taken out by itself with ``try_variant_get``, so a field that does
not fit is NULL alone.  Everything is an expression inside the row: no UDF, no explode, no shuffle.

Rules: a number in text counts as that number and a scalar where text is asked for as its text; a
NaN or infinite number is NULL; an object or list where a scalar is asked for is NULL; a list's
elements that do not fit stay as NULL places; a document that is no JSON, or repeats a key within
an object, is NULL as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALAR_KINDS = "^(STRING|BOOLEAN|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
_FRACTIONS = (T.DoubleType, T.FloatType)


def _path(name: str) -> str:
    """Path of one field: names may hold any characters (``energy-kcal_100g``) but both quotes,
    as a path has no escapes."""
    quote = "'" if '"' in name else '"'
    if quote in name:
        raise ValueError(f"a field name with both kinds of quotes has no path: {name}")
    return f"$[{quote}{name}{quote}]"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _path(name), "variant")


def _scalar(v: Column, want: T.DataType) -> Column:
    if isinstance(want, T.StringType):
        return F.when(F.schema_of_variant(v).rlike(_SCALAR_KINDS), F.try_variant_get(v, "$", "string"))
    value = F.try_variant_get(v, "$", want.simpleString())
    if isinstance(want, _FRACTIONS):  # NaN orders above every number
        return F.when((value > float("-inf")) & (value < float("inf")), value)
    return value


def shaped(v: Column, schema: T.DataType | str) -> Column:
    """The VARIANT ``v`` as ``schema``, field by field: what does not fit is NULL by itself."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if isinstance(want, T.StructType):
        fields = [shaped(_field(v, f.name), f.dataType).alias(f.name) for f in want.fields]
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: shaped(x, want.elementType))
    if isinstance(want, T.MapType):
        return F.transform_values(F.try_variant_get(v, "$", "map<string, variant>"),
                                  lambda _, x: shaped(x, want.valueType))
    return _scalar(v, want)


def from_drifted_json(c, schema: T.DataType | str) -> Column:
    """JSON text (or a VARIANT column ``v`` by ``shaped``) as ``schema``; malformed text is NULL."""
    return shaped(F.try_parse_json(F.col(c) if isinstance(c, str) else c), schema)


def with_drifted_json(df: DataFrame, json_col: str, schema: T.DataType | str) -> DataFrame:
    """``df`` with the text of ``json_col`` replaced by its parsed document.  The text becomes a
    VARIANT in a projection of its own, once per row."""
    kept = [c for c in df.columns if c != json_col]
    d = df.select(*kept, F.try_parse_json(F.col(json_col)).alias("_variant"))
    return d.select(*kept, shaped(F.col("_variant"), schema).alias(json_col))


def read_drifted_lines(spark: SparkSession, path: str, schema: T.DataType | str) -> DataFrame:
    """JSON lines as one column ``doc``; a malformed line is a NULL document, blank lines go."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "doc")
    return with_drifted_json(lines, "doc", schema)
