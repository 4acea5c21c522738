"""Text functions as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphfold.errors import Invalid

#: White space as Unicode has it, with the four separators that Java's class leaves out.
_WS = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A query that contains one of these asks about the whole corpus.
THEMATIC = (
    "overview",
    "theme",
    "themes",
    "across",
    "overall",
    "summary",
    "summarize",
    "high-level",
    "high level",
    "broadly",
    "in general",
    "what are the main",
    "main topics",
    "corpus",
    "entire",
    "whole dataset",
)
#: What a token of a query is, and the form of a header.
TOKEN = r"[a-z0-9][a-z0-9._-]{1,}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def clean_name(c: Column) -> Column:
    """White space collapsed, case kept; null gives an empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, _WS, " ")), F.lit(""))


def normalize_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, _WS, " ")))


def normalize_type(c: Column) -> Column:
    t = F.translate(F.lower(strip(c)), " -", "__")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("concept"))


def clean_type(c: Column) -> Column:
    t = F.regexp_replace(F.translate(F.lower(strip(F.coalesce(c, F.lit("concept")))), " -", "__"), "[^a-z0-9_]+", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("concept"))


def _member(name: str) -> str:
    """The path of a member, whatever its name holds."""
    if "'" in name and '"' in name:
        raise Invalid(f"a member's name may hold one kind of quotes: {name}")
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


def _holds(value: Column, wanted) -> Column:
    kind = F.schema_of_variant(value)
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, dict):
        out = kind.startswith("OBJECT")
        for name, want in wanted.items():
            out = out & F.coalesce(_holds(F.try_variant_get(value, _member(name), "variant"), want), F.lit(False))
        return out
    if isinstance(wanted, (list, tuple)):
        items, out = F.try_variant_get(value, "$", "array<variant>"), kind.startswith("ARRAY")
        holds = lambda want: lambda x: F.coalesce(_holds(x, want), F.lit(False))
        for want in wanted:
            out = out & F.coalesce(F.exists(items, holds(want)), F.lit(False))
        return out
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    number = kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL")
    exact = F.try_variant_get(value, "$", "decimal(38,12)") == F.lit(Decimal(str(wanted))).cast("decimal(38,12)")
    return number & F.coalesce(exact, F.try_variant_get(value, "$", "double") == F.lit(float(wanted)))


def contains_props(props: Column, wanted: dict) -> Column:
    """Whether an object in JSON contains the wanted one: its members, at any depth, with values of the same kind that are
    equal. Numbers are equal by value, true is no number, and an array contains another if each of that one's items is
    contained in one of its own. Nothing but what is wanted is compared; a text that is not JSON contains nothing."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(_holds(F.try_parse_json(props), wanted), F.lit(False))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalize_name(c), F.lit(TOKEN), F.lit(0))


def phrases(c: Column) -> Column:
    """The normalised query, its tokens and pairs of neighbouring tokens."""
    t = tokens(c)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.filter(F.array_union(F.array(normalize_name(c)), F.array_union(t, pairs)), lambda x: x != "")


def thematic(c: Column) -> Column:
    q = F.lower(c)
    return F.exists(F.array(*map(F.lit, THEMATIC)), lambda k: F.contains(q, k))


def header_block(name: Column, kind: Column, chunk_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[node:"), name, F.lit("|"), kind, F.lit("|chunk:"), chunk_id, F.lit("]\n"), text)


def informative(c: Column) -> Column:
    """Neither empty nor exactly the word that a model answers when it knows nothing."""
    return ~F.upper(strip(F.coalesce(c, F.lit("")))).isin("", "NO_INFO")


def excerpt(c: Column, n: int = 280) -> Column:
    return F.substring(c, 1, n)
