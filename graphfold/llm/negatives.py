"""Hard negatives by inner product, from inverted lists with radii.

Rows are dealt to the nearest of a set of centroids (k-means on the TRAIN_ROWS rows
with the smallest hashes of their ids), and each list keeps its radius, the largest
distance of a row from the centroid. By Cauchy and Schwarz no row of a list scores
more than q.c + |q| r against an anchor q, nor less than q.c - |q| r. An anchor
visits the lists by falling upper bound and skips those whose bounds lie outside
its window of scores. It stops when the bound falls strictly below the k-th score:
it first visits lists that hold PROBE rows, and with the k-th score of those all
the others that the bound does not rule out, so that the result is exact.

Anchors and rows meet in a grid: a list is dealt to parts of about PART rows and
the anchors to blocks of about BLOCK, so that no task holds more of either, and
scores are products of two matrices. A row is sent only to the blocks of anchors
that visit its list.

Edge cases: rows without an id, with a null label or vector, or with null or
non-finite components take no part. A shorter vector counts as one that ends with
zeros. Rows of an anchor's own id are not its positives; an id that several anchor
rows have is one anchor, the one with the least label and vector. Other rows that
repeat an id all count. Scores beyond 2**56 are an error. A window is empty where
the positive's score is negative. Extra columns do not matter; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.ann import codebook, matrix, squared
from graphfold.llm.common import arrow_rows, discard, materialize, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
TRAIN_ROWS, LISTS, LIST_ROWS, PROBE = 20_000, 256, 2_048, 4_096
PART, BLOCK, CELLS = 32_768, 32_768, 1 << 20
#: Below it, products and windows of scores are exact in 64 bits.
MOST = 2.0**56
_NONE = -(1 << 62)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_rows(df: DataFrame, key: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with components floor(scale * x) in the narrowest integers, all of one length."""
    x = F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))))
    v = F.transform("x", lambda y: F.floor(y * scale))
    most = rows.select(F.size("x").alias("n"), F.array_max(F.transform("x", lambda y: F.abs(y * scale) + 1)).alias("m")).agg(F.max("n").alias("n"), F.max("m").alias("m")).collect()[0]
    n, largest = most["n"] or 0, most["m"] or 0
    if largest >= MOST:
        raise ValueError("components are too large for scores in 64 bits")
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "bigint"
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(max(n, 1)) - F.size("v")))
    return rows.select("vec_id", "label", v.alias("v")).select("vec_id", "label", padded.cast(f"array<{kind}>").alias("v"))


@dataclass
class Lists:
    """Centroids, the radius and number of rows of each list, and the table of rows (vec_id, label, v, list, spread)."""

    centroids: np.ndarray
    radii: np.ndarray
    held: np.ndarray
    rows: DataFrame


def build(rows: DataFrame, lists: int = LISTS, train_rows: int = TRAIN_ROWS) -> Lists | None:
    """Deals every row of (vec_id, label, v) to a list; None if there is none."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).select("v").toArrow()
    if not some.num_rows:
        return None
    n = rows.count()
    book = codebook(matrix(some.column("v")).astype(np.float64), max(1, min(lists, n // LIST_ROWS)))
    shared = rows.sparkSession.sparkContext.broadcast(book)  # `lists` rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, rng = shared.value, np.random.default_rng(TaskContext.get().partitionId())
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x = matrix(batch.column("v")).astype(np.float64)
                near = squared(x, book).argmin(1)
                far = np.sqrt(((x - book[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(rng.random(len(x))), pa.array(far)], names=["vec_id", "label", "v", "list", "spread", "far"])

    kinds = [(f.name, f.dataType) for f in rows.schema.fields]
    dealt = materialize(arrow_rows(rows, deal, [*kinds, ("list", T.IntegerType()), ("spread", T.DoubleType()), ("far", T.DoubleType())]), "negative_lists")
    radii, held = np.zeros(len(book)), np.zeros(len(book), np.int64)
    for r in dealt.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # at most `lists` rows
        radii[r["list"]], held[r["list"]] = r["far"], r["n"]
    return Lists(book, radii, held, dealt.drop("far"))


#: What an anchor asks for: the best rows with lo <= score <= hi, where `best` is the k-th score so far.
_WANT = "array<struct<slot:bigint,lo:bigint,hi:bigint,best:bigint>>"


def _bounds(q: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of each list's rows, with room for rounding."""
    book, radii = index
    middle, reach = q @ book.T, np.sqrt((q * q).sum(1))[:, None] * radii
    reach += 1 + 1e-9 * (np.abs(middle) + reach)
    return middle + reach, middle - reach


def _chosen(asks: DataFrame, index: Lists, later: bool) -> DataFrame:
    """asks with the lists to visit: first those of the highest bounds, later the others that may hold something."""
    shared = asks.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, radii, held = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                upper, lower = _bounds(matrix(batch.column("v")).astype(np.float64), (book, radii))
                out = []
                for up, low, wants in zip(upper, lower, batch.column("wants").to_pylist(), strict=True):
                    open_ = np.zeros(len(up), bool)
                    go_on = open_.copy()
                    for w in wants:
                        fits = (up >= w["lo"]) & (low <= w["hi"]) & (held > 0)
                        open_ |= fits
                        go_on |= fits & (up >= w["best"])
                    order = np.argsort(-up, kind="stable")
                    order = order[open_[order]]
                    n = int(np.searchsorted(np.cumsum(held[order]), PROBE)) + 1
                    out.append((order[n:][go_on[order[n:]]] if later else order[:n]).astype(np.int32))
                lists = pa.array(out, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return arrow_rows(asks, run, [*((f.name, f.dataType) for f in asks.schema.fields), ("lists", T.ArrayType(T.IntegerType()))])


def _firsts(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores that fit, of equal ones those of smaller ids."""
    if score.shape[1] > 4 * k:
        limit = np.partition(np.where(fits, score, _NONE), -k, axis=1)[:, -k]
        fits = fits & (score >= limit[:, None])
    i, j = np.nonzero(fits)
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.diff(i, prepend=-1))
    place = np.arange(len(i)) - np.repeat(start, np.diff(start, append=len(i)))
    return i[place < k], j[place < k]


def _meet(same: bool, k: int):
    """Scores of a block of anchors against a part of a list; k rows for each want, of the anchor's label or of others."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if asks.num_rows and rows.num_rows:
            q, x = matrix(asks.column("v")), matrix(rows.column("v"))
            length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()
            most = length(q) * length(x)
            if most >= MOST:
                raise ValueError("vectors are too long for scores in 64 bits")
            kind = np.float64 if most < 2.0**52 else np.int64  # products of doubles are exact up to there
            x = x.astype(kind).T
            ids, label, anchor, own = (t.column(c).to_numpy() for t, c in ((rows, "vec_id"), (rows, "label"), (asks, "vec_id"), (asks, "label")))
            wants = asks.column("wants").to_pylist()
            step = max(1, CELLS // len(ids))
            for at in range(0, len(anchor), step):
                score = (q[at : at + step].astype(kind) @ x).astype(np.int64)
                fits = label == own[at : at + step, None]
                fits = fits & (ids != anchor[at : at + step, None]) if same else ~fits
                of = wants[at : at + step]
                for w in range(max(map(len, of))):
                    one = [x[w] if w < len(x) else {"slot": 0, "lo": 1, "hi": 0, "best": 0} for x in of]
                    lo, hi, slot = (np.array([x[c] for x in one])[:, None] for c in ("lo", "hi", "slot"))
                    best = np.array([x["best"] for x in one])[:, None]
                    i, j = _firsts(score, ids, fits & (score >= np.maximum(lo, best)) & (score <= hi), k)
                    for c, values in zip(out, (anchor[at + i], slot[i, 0], ids[j], score[i, j]), strict=True):
                        c.append(values)
        return pa.table({c: pa.array(np.concatenate(values), pa.int64()) for c, values in zip(("vec_id", "slot", "found", "score"), out, strict=True)})

    return run


def _visit(asks: DataFrame, index: Lists, same: bool, k: int, later: bool) -> DataFrame:
    """(vec_id, slot, found, score) from the lists of a round."""
    spark = asks.sparkSession
    asks = materialize(_chosen(asks, index, later), "negative_asks")
    parts = spark.createDataFrame([(i, int(-(-n // PART))) for i, n in enumerate(index.held.tolist()) if n], "list int, parts int")
    blocks = asks.select(F.col("block").alias("of"), F.explode("lists").alias("list")).distinct().withColumnRenamed("of", "block")
    right = index.rows.join(blocks, "list").join(F.broadcast(parts), "list").withColumn("part", F.floor(F.col("spread") * F.col("parts")).cast("int"))  # `lists` rows
    left = asks.withColumn("list", F.explode("lists")).drop("lists").join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["list", "part", "block"]
    met = left.select(*key, "vec_id", "label", "v", "wants").groupBy(*key).cogroup(right.select(*key, "vec_id", "label", "v").groupBy(*key)).applyInArrow(_meet(same, k), "vec_id long, slot long, found long, score long")
    met = materialize(met, "negative_hits")
    discard(asks)
    return met


def _best(asks: DataFrame, index: Lists, same: bool, k: int) -> DataFrame:
    """(vec_id, slot, found, score, rank): what each anchor's wants come to, in two rounds."""
    by = Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "found")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    first = materialize(top(_visit(asks, index, same, k, False)).drop("rank"), "negative_first")
    kth = first.groupBy("vec_id", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where(F.col("kth").isNotNull())
    kth = kth.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))  # as many as wants
    best = lambda w: F.coalesce(F.try_element_at("kth", w["slot"]), w["best"])
    known = asks.join(kth, "vec_id", "left").withColumn("wants", F.transform("wants", lambda w: F.struct(w["slot"].alias("slot"), w["lo"].alias("lo"), w["hi"].alias("hi"), best(w).alias("best"))))
    return top(first.unionByName(_visit(known.select(*asks.columns), index, same, k, True)))


def _percent(score: Column, part: int) -> Column:
    """floor(part * score / 100), exact."""
    x = score * F.lit(part).cast("long")
    return ((x - F.pmod(x, F.lit(100).cast("long"))).cast("decimal(20,0)") / 100).cast("long")


def mine(index: Lists, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor (vec_id, label, v) and each of its `positives` best rows of its label, the `negatives` best rows of
    other labels that score from low to high percent of what the positive does."""
    wants = lambda slot, lo, hi: F.struct(slot.cast("long").alias("slot"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(_NONE).cast("long").alias("best"))
    anchors = materialize(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "anchors")
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    everything = F.array(wants(F.lit(0), F.lit(_NONE), F.lit(-_NONE))).cast(_WANT)
    best = _best(anchors.withColumn("wants", everything), index, True, positives)
    # a row that repeats an id with the same score is the same positive; its rank names the want
    near = best.groupBy("vec_id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).agg(F.min("rank").cast("long").alias("slot"))
    near = materialize(near, "positives")
    s = F.col("positive_score")
    lo, hi = -_percent(-s, low), _percent(s, high)
    windows = near.where(lo <= hi).groupBy("vec_id").agg(F.collect_list(wants(F.col("slot"), lo, hi)).cast(_WANT).alias("wants"))  # `positives` entries
    found = _best(anchors.join(windows, "vec_id"), index, False, negatives)
    return found.join(near, ["vec_id", "slot"]).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_rows(e.select("vec_id", label.alias("label"), "embedding"), "vec_id", "label", "embedding")
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    return mine(index, index.rows.where(F.col("vec_id") % 50 == 0).select("vec_id", "label", "v"))
