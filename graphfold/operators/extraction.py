"""Reading a model's extraction reply: entities and relationships in JSON, perhaps fenced or with text around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.functions.text import clean_name, clean_type, strip

ENTITY = "struct<name:string,type:string,description:string>"
RELATION = "struct<source:string,target:string,type:string,description:string>"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row: a generator is not merged into the expressions that use it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def unfenced(raw: Column) -> Column:
    """A reply without white space around, or what its first fence holds."""
    fence = r"^[\s\S]*?```(?:json)?\s*([\s\S]*?)```[\s\S]*$"
    t = strip(F.coalesce(raw, F.lit("")))
    return F.when(F.contains(t, F.lit("```")), strip(F.regexp_replace(t, fence, "$1"))).otherwise(t)


def parsed(text: Column) -> Column:
    """The JSON value of a text, or else of what stands from its first to its last brace."""
    block = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(block, F.lit(""))))


def _items(value: Column) -> Column:
    """A list's members; none for a value that is empty, null for any other."""
    none = F.array().cast("array<variant>")
    empty = value.isNull() | F.is_variant_null(value) | F.to_json(value).isin("false", "0", "0.0", '""', "{}")
    return F.when(empty, none).otherwise(F.try_variant_get(value, "$", "array<variant>"))


def _texts(items: Column, *names: str) -> Column:
    """The members of objects as texts; a member that is missing, null, false, zero or empty is null, true reads as True."""
    rows = F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.struct(*(F.try_variant_get(x, f"$.{n}", "string").alias(n) for n in names)))
    text = lambda v: F.when(v.isin("", "false", "0", "0.0", "[]", "{}"), None).when(v == "true", "True").otherwise(v)
    return F.transform(rows, lambda x: F.struct(*(text(x[n]).alias(n) for n in names)))


def parse(df: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """df with status (ok, empty, invalid), entities and relationships.

    Names are cleaned and nameless entities go; types are cleaned, with `concept`
    and `related_to` as defaults; relationships without both ends, or between equal
    names, go. With strict, a reply that is not ok raises.
    """
    df = _once(df, __text=unfenced(F.col(raw)))
    df = _once(df, __json=parsed(F.col("__text")))
    member = lambda name: F.try_variant_get("__json", f"$.{name}", "variant")
    df = _once(df, __object=F.schema_of_variant("__json").startswith("OBJECT"), __e=member("entities"), __r=member("relationships"))
    df = _once(df, __entities=_items(F.col("__e")), __relations=_items(F.col("__r")))
    status = F.when(F.col("__text") == "", F.when(strip(F.coalesce(raw, F.lit(""))) == "", "empty").otherwise("invalid"))
    status = status.when(~F.coalesce("__object", F.lit(False)) | F.col("__entities").isNull() | F.col("__relations").isNull(), "invalid").otherwise("ok")
    if strict:
        status = F.when(status == "ok", "ok").otherwise(F.raise_error(F.concat(F.lit("extraction reply is "), status)).cast("string"))
    df = _once(df, status=status, __entities_=_texts(F.col("__entities"), "name", "type", "description"), __relations_=_texts(F.col("__relations"), "source", "target", "type", "description"))
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    entities = F.transform("__entities_", lambda x: F.struct(clean_name(x["name"]).alias("name"), clean_type(x["type"]).alias("type"), text(x["description"]).alias("description")))
    kind = lambda x: clean_type(F.coalesce(x["type"], F.lit("related_to"))).alias("type")
    relations = F.transform("__relations_", lambda x: F.struct(clean_name(x["source"]).alias("source"), clean_name(x["target"]).alias("target"), kind(x), text(x["description"]).alias("description")))
    entities = F.filter(entities, lambda x: x["name"] != "")
    relations = F.filter(relations, lambda x: (x["source"] != "") & (x["target"] != "") & (F.lower(x["source"]) != F.lower(x["target"])))
    ok = F.col("status") == "ok"
    df = _once(df, entities=F.when(ok, entities), relationships=F.when(ok, relations))
    return df.drop("__text", "__json", "__object", "__e", "__r", "__entities", "__relations", "__entities_", "__relations_")
