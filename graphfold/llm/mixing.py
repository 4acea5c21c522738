"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic. The cells' token
weights are raked to the marginal targets of all three in turn until they agree,
and each document is kept with the probability of its cell: the raked weight over
the cell's tokens, scaled so that the expected tokens are `rate` of all. Cells
that reach probability one stop there, and the others take over what is left.

Every source, language and topic has cells and a target of its own. Up to GATHER
cells are raked on the driver; more are raked where they lie, with an aggregation
and a join for each dimension and round, which gives the same weights. Documents
get their cell's probability by a join that spreads the largest cells. Tokens are
counted over all documents. The topic is a column `topic` where the documents have
one, which a topic model may have filled, and else the make-up of the text.

A rate near 1 leaves the cells little room: those that reach probability one hold
more than their share, and the sample misses its targets. Mixture.marginals()
says what each value was to get, what raking gave it and what the sample holds.

Edge cases: a null or empty text has no tokens, topic `empty`, and takes the
probability of its cell; a text of white space alone has no tokens either; null sources and languages count as the value ``. A
target for a value that does not occur is left out and the others are scaled. A
decision depends on doc_id and the cell alone, so repeated rows are kept or
dropped together. Texts of any length are counted whole. Columns of the stage's
input keep their names; names that begin with two underscores are for the
operator. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfold.llm.common import attach, discard, materialize, table

#: Cells that the driver may hold, and the end of raking.
GATHER, ROUNDS, TOLERANCE = 100_000, 500, 1e-10
DIMS = {"__source": "source", "__lang": "lang", "__topic": "topic"}
RATE, SEED = 0.5, 20_240_601
#: Exponents that flatten the observed shares; a dict of fixed shares does too.
TARGETS: dict[str, float | dict[str, float]] = {
    "source": 0.5,
    "lang": 0.7,
    "topic": 0.9,
}


def n_tokens(text: Column) -> Column:
    """Runs of characters that are not white space (Unicode's, U+00A0 among it) in the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from the text's make-up."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    share = lambda signs: (n - F.length(F.translate(t, signs, ""))) / n
    return (
        F.when(n == 0, "empty")
        .when(share("#$%&*|<>{}[]=") > 0.02, "markup")
        .when(share("0123456789") > 0.05, "numeric")
        .when(t.rlike("[Ll]icense|[Cc]opyright|rights reserved"), "legal")
        .when(n < 200, "short")
        .otherwise("prose")
    )


def shares(tokens: dict[str, float], target: float | dict[str, float]) -> dict[str, float]:
    """Target shares of the values that occur; an exponent flattens the observed ones."""
    got = {k: float(target.get(k, 0.0)) for k in tokens} if isinstance(target, dict) else {k: v**target for k, v in tokens.items()}
    got = got if sum(got.values()) > 0 else dict(tokens)
    whole = sum(got.values())
    return {k: v / whole for k, v in got.items()} if whole else got


def rake(tokens: np.ndarray, dims: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights with the marginal shares of targets: each dimension's marginals are set in turn until none changes."""
    w = tokens.astype(np.float64).copy()
    if not w.sum():
        return w
    w /= w.sum()
    for _ in range(rounds):
        worst = 0.0
        for at, target in zip(dims, targets, strict=True):
            now = np.bincount(at, w, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            w *= factor[at]
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0.0)))
        if worst < tolerance:
            break
    return w


def probabilities(tokens: np.ndarray, weights: np.ndarray, rate: float) -> np.ndarray:
    """min(1, scale * weight / tokens) with the scale that makes the expected tokens rate * all, as far as cells allow."""
    ratio = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    budget = rate * tokens.sum()
    full = np.zeros(len(tokens), bool)
    while True:
        rest = weights[~full].sum()
        scale = (budget - tokens[full].sum()) / rest if rest > 0 else 0.0
        over = ~full & (ratio * scale > 1)
        if not over.any():
            return np.where(full, 1.0, np.minimum(1.0, ratio * max(scale, 0.0)))
        full |= over


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)


def features(docs: DataFrame) -> DataFrame:
    """docs with the values of their cells and their tokens."""
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return docs.withColumns({"__source": value("source"), "__lang": value("lang"), "__topic": value("topic") if "topic" in docs.columns else topic(F.col("text")), "__tokens": n_tokens(F.col("text"))})


def _gathered(cells: DataFrame, targets: dict[str, float | dict[str, float]], rate: float) -> DataFrame:
    """Rakes at most GATHER cells on the driver."""
    got = cells.toArrow().sort_by([(c, "ascending") for c in DIMS])
    tokens = got.column("__tokens").to_numpy().astype(np.float64)
    dims, wanted = [], []
    for column, name in DIMS.items():
        values, at = np.unique(np.array(got.column(column).to_pylist(), object), return_inverse=True)
        share = shares(dict(zip(values.tolist(), np.bincount(at, tokens, len(values)).tolist(), strict=True)), targets[name])
        dims.append(at)
        wanted.append(np.array([share[v] for v in values]))
    weights = rake(tokens, dims, wanted)
    chance = probabilities(tokens, weights, rate)
    observed = tokens / tokens.sum() if tokens.sum() else tokens
    ratio = np.divide(weights, observed, out=np.zeros(len(tokens)), where=observed > 0)
    out = pa.table({**{c: got.column(c) for c in (*DIMS, "__docs", "__tokens")}, "__weight": np.round(ratio, 9), "__probability": np.round(chance, 9)})
    return cells.sparkSession.createDataFrame(out)


def _wanted(cells: DataFrame, column: str, target: float | dict[str, float]) -> DataFrame:
    """shares() of a column's values as a table, with the number of each value's cells."""
    values = cells.groupBy(column).agg(F.sum("__tokens").cast("double").alias("n"), F.count("*").alias("__cells"))
    if isinstance(target, dict):
        fixed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{column} string, v double")
        values = values.join(fixed, column, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    else:
        values = values.withColumn("v", F.pow("n", F.lit(float(target))))
    values = materialize(values, "mixing_values")
    v, n = values.agg(F.sum("v"), F.sum("n")).collect()[0]
    return values.select(column, "__cells", (F.col("v") / v if v > 0 else F.col("n") / n).alias("share"))


def _spread(cells: DataFrame, targets: dict[str, float | dict[str, float]], rate: float) -> DataFrame:
    """rake() and probabilities() of any number of cells."""
    spark = cells.sparkSession
    whole = cells.agg(F.sum("__tokens")).collect()[0][0]
    if not whole:
        return cells.select(*DIMS, "__docs", "__tokens", F.lit(0.0).alias("__weight"), F.lit(0.0).alias("__probability"))
    wanted = {column: _wanted(cells, column, targets[name]) for column, name in DIMS.items()}
    now = materialize(cells.withColumn("w", F.col("__tokens") / F.lit(float(whole))), "mixing_weights")
    for k in range(ROUNDS):
        worst = 0.0
        for column in DIMS:
            sums = now.groupBy(column).agg(F.sum("w").alias("now"))
            factor = F.when(F.col("now") > 0, F.col("share") / F.col("now"))
            factors = materialize(wanted[column].join(sums, column).select(column, "__cells", factor.alias("factor")), "mixing_factors")
            worst = max(worst, factors.agg(F.max(F.abs(F.col("factor") - 1))).collect()[0][0] or 0.0)
            after = attach(now, factors, [column], "__cells", list(DIMS)).withColumn("w", F.col("w") * F.coalesce("factor", F.lit(0.0))).drop("factor")
            after = materialize(after, "mixing_weights")
            discard(factors)
            discard(now)
            now = after
        if worst < TOLERANCE:
            break
    ratio = F.when(F.col("__tokens") > 0, F.col("w") / F.col("__tokens")).otherwise(0.0)
    scale, full = 0.0, -1
    while True:  # the scale only grows, so cells that are full stay so
        over = ratio * scale > 1
        count, held, rest = now.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("__tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).collect()[0]
        if count == full:
            break
        full = count
        if rest <= 0 or rate * whole <= held:
            break
        scale = (rate * whole - held) / rest
    return now.select(*DIMS, "__docs", "__tokens", F.round(ratio * float(whole), 9).alias("__weight"), F.round(F.least(F.lit(1.0), ratio * scale), 9).alias("__probability"))


class Mixture:
    """Raked cells, a row for each combination of source, language and topic that occurs."""

    def __init__(self, cells: DataFrame, targets: dict[str, float | dict[str, float]]):
        self.cells, self.targets = cells, targets

    def marginals(self) -> DataFrame:
        """(dimension, value, observed, target, raked, sampled): shares of tokens before and after, a row for each value.
        `sampled` is what the probabilities lead to expect."""
        out = None
        for column, name in DIMS.items():
            wanted = _wanted(self.cells, column, self.targets[name]).select(column, F.col("share").alias("target"))
            sums = [F.sum(x).alias(y) for x, y in ((F.col("__tokens"), "o"), (F.col("__tokens") * F.col("__weight"), "r"), (F.col("__tokens") * F.col("__probability"), "s"))]
            whole = self.cells.agg(*sums).collect()[0]
            share = lambda c, whole=whole: (F.col(c) / F.lit(float(whole[c] or 0) or None)).alias({"o": "observed", "r": "raked", "s": "sampled"}[c])
            rows = self.cells.groupBy(column).agg(*sums).join(wanted, column).select(F.lit(name).alias("dimension"), F.col(column).alias("value"), share("o"), "target", share("r"), share("s"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def decide(self, docs: DataFrame) -> DataFrame:
        """docs (from features()) with __weight, __probability and __sampled."""
        out = attach(docs, self.cells.drop("__tokens"), list(DIMS), "__docs", ["doc_id", "__tokens"])
        return out.withColumn("__sampled", uniform(F.col("doc_id")) < F.col("__probability"))


def calibrate(docs: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, rate: float = RATE) -> Mixture:
    """Counts the cells of all documents (from features()) and rakes them."""
    targets = targets or TARGETS
    cells = materialize(docs.groupBy(*DIMS).agg(F.sum("__tokens").alias("__tokens"), F.count("*").alias("__docs")), "mixing_cells")
    raked = _gathered(cells, targets, rate) if cells.count() <= GATHER else _spread(cells, targets, rate)
    return Mixture(materialize(raked, "mixing_raked"), targets)


def mix(docs: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (raked over observed share), probability and sampled of each document."""
    # texts are looked at once: what is known of them is written without them
    docs = materialize(features(docs.select("doc_id", "text", "source", "lang", *(c for c in docs.columns if c == "topic"))).drop("text", "topic"), "mixing_docs")
    out = calibrate(docs, targets, rate).decide(docs)
    return out.select("doc_id", "source", "lang", *(F.col(f"__{x}").alias(y) for x, y in (("topic", "topic"), ("tokens", "n_tokens"), ("weight", "weight"), ("probability", "probability"), ("sampled", "sampled"))))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_tokens(spark, sf_dir: str) -> DataFrame:
    """The number of tokens that op8_mixing rakes, of each document."""
    return op8_mixing(spark, sf_dir).select("doc_id", "n_tokens")


def stage(spark, docs: DataFrame, sf_dir: str, rate: float = 0.9) -> DataFrame:
    """Keeps the sampled documents."""
    found = features(docs)
    return calibrate(found, rate=rate).decide(found).where("__sampled").select(*docs.columns)
