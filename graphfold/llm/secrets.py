"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Fixed patterns find assignments, access keys and hexadecimal strings. Spans come
from splitting a text at a pattern's matches: the lengths of the pieces and of
the matches add up to the positions, in code points.

The Markov models judge every run of LEAST_RUN or more key characters, whatever
it is made of. Two order-1 models over the same alphabet, of random strings
and of ordinary words, are trained from labelled samples: the values that the
fixed patterns found, and the words outside of them. A run whose log-likelihood
ratio is large, in sum and on average, is a span of kind `random`.

The models are fitted on the documents with the smallest hashes of their ids:
RANDOM_DOCS of them for random strings and WORD_DOCS for words. Counts have at
most 2 * 67 * 67 rows. Every document is scanned whole.

Edge cases: a null text counts as empty and has no spans; with no sample of
random strings their model is uniform; repeated rows get equal results. Texts of
any length are scanned whole; an empty table gives an empty result. Spans that
start together are listed in the order of their kinds. Extra columns are kept by
scan(); one with the name of an output is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import table

#: The kinds in their order, with pattern, group that counts and least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_KEY = "A-Za-z0-9+/_=-"
LEAST_RUN = 16
#: Whole runs of key characters. The look-behind lets a match begin at a run's start only.
RUN = rf"(?<![{_KEY}])[{_KEY}]{{{LEAST_RUN},}}+"
RANDOM_DOCS, WORD_DOCS = 20_000, 1_000
LEAST_SUM, LEAST_MEAN = 12.0, 0.5
_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, guard: Column, pattern: str, kind: int, good) -> Column:
    """Matches of pattern as spans; good(match, group 2 or match) tells which stay."""
    group = 2 if kind == 0 else 0
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")).cast(_SPAN))
        return F.struct(end.alias("pos"), F.when(good(x["value"]), F.concat(acc["out"], span)).otherwise(acc["out"]).cast(f"array<{_SPAN}>").alias("out"))

    fold = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(guard, fold).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of the three fixed patterns, sorted by start and kind."""
    always = lambda value: F.lit(True)
    return F.array_sort(
        F.concat(
            _spans(text, text.rlike(ASSIGN), ASSIGN, 0, lambda value: F.length(value) >= 8),
            _spans(text, text.contains("AKIA") & text.rlike(ACCESS), ACCESS, 1, always),
            _spans(text, text.rlike(HEX), HEX, 2, always),
        )
    )


def _bigrams(token: Column) -> Column:
    """Alphabet positions of adjacent characters, as a * 67 + b."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.size(at) - 1
    # two shifted arrays: an array that a lambda names would be built again for each element
    return F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: a * len(ALPHABET) + b)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """Log-likelihood ratios of all 67 * 67 bigrams, random over ordinary."""
    n = len(ALPHABET)

    def sample(rows: int) -> DataFrame:
        # at most `rows` ids: a fixed bound for the broadcast
        ids = docs.select(F.col(doc_id).alias("__id")).where(F.col("__id").isNotNull()).orderBy(F.xxhash64("__id"), "__id").limit(rows).distinct()
        return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id", "left_semi").where(F.col("__text").isNotNull())

    hits = sample(RANDOM_DOCS).select("__text", F.explode(base_spans(F.col("__text"))).alias("s"))
    value = F.substring(F.col("__text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    value = F.when(F.col("s.kind") == 0, F.regexp_extract(value, ASSIGN, 2)).otherwise(value)
    random = hits.select(F.lit(1).alias("kind"), F.regexp_replace(value, rf"[^{_KEY}]", "").alias("token"))
    rest = F.regexp_replace(F.regexp_replace(F.col("__text"), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = sample(WORD_DOCS).select(F.lit(0).alias("kind"), F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z][A-Za-z0-9_-]{5,}"), F.lit(0))).alias("token"))
    pairs = random.union(words).where(F.length("token") >= 2).select("kind", F.explode(_bigrams(F.col("token"))).alias("pair"))
    counts = {(r["kind"], r["pair"]): r["n"] for r in pairs.groupBy("kind", "pair").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(n):
        rows = [[counts.get((kind, a * n + b), 0) for b in range(n)] for kind in (0, 1)]
        totals = [sum(r) + n * w for r, w in zip(rows, (0.5, 0.5), strict=True)]
        out += [round(math.log((rows[1][b] + 0.5) / totals[1]) - math.log((rows[0][b] + 0.5) / totals[0]), 6) for b in range(n)]
    return out


def random_spans(text: Column, ratios: list[float]) -> Column:
    """The spans that the Markov models take for random strings."""
    values = F.from_json(F.lit("[" + ",".join(map(str, ratios)) + "]"), "array<double>")

    def good(token: Column) -> Column:
        score = F.aggregate(_bigrams(token), F.lit(0.0), lambda acc, pair: acc + F.element_at(values, pair + 1))
        return (score >= LEAST_SUM) & (score >= LEAST_MEAN * (F.length(token) - 1))

    return _spans(text, text.rlike(RUN), RUN, 3, good)


def scan(docs: DataFrame, ratios: list[float], text: str = "text", base: str = "base_spans", output: str = "all_spans") -> DataFrame:
    """docs with the spans of the fixed patterns, and with all spans, sorted by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(*(c for c in docs.columns if c not in (base, output)))
    return docs.withColumn(base, base_spans(t)).withColumn(output, F.array_sort(F.concat(F.col(base), random_spans(t, ratios))))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with mark in place of each span; overlapping spans get one mark. spans are sorted."""
    none = F.from_json(F.lit("[]"), "array<string>")

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], piece)).otherwise(acc["out"]).cast("array<string>")
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, finish)).otherwise(text)


def _base_columns() -> list[Column]:
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return [F.col("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256")]


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs)).select(*_base_columns(), spans_text(F.col("all_spans")).alias("spans"))


def base_secrets(spark, sf_dir: str) -> DataFrame:
    """What op7 returns without its models."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base_spans")).select(*_base_columns())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; n_chars follows the text."""
    found = scan(docs, fit(docs.select("doc_id", "text")), base="__base", output="__spans")
    # the masked text has a column of its own, so that its length is taken of what was built and not of a second build
    found = found.withColumn("__masked", redact(F.col("text"), F.col("__spans")))
    changed = F.size("__spans") > 0
    n_chars = lambda c: F.when(changed, F.length("__masked").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return found.select(*(F.col("__masked").alias(c) if c == "text" else n_chars(c) if c == "n_chars" else F.col(c) for c in docs.columns))
