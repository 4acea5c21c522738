"""Mining phrases from vertical positional inverted lists.

Texts are dealt to shards of a bounded number of words, and a shard has, for each
word, the sorted list of its positions. Phrases grow word by word: within a shard
the positions of the frequent phrases of k words are merge-joined with the
postings of the words that follow, and the lengths of the new lists, summed over
the shards, are exact frequencies. Only phrases whose first and last k words are
frequent are extended, so that each level meets no more than the level before
left. Positions never leave their shard; what is shuffled by phrase are counts,
and which phrases are frequent goes back to the shards: to all of them while they
are few, which is counted, else to a shard those that it holds.

A candidate's score is the least of its cuts' in two, and candidates that a longer
one accounts for are dropped; both are joins on the table of frequent phrases.

Edge cases: a null or empty text has no words, a null language is `und`. Every row
counts, repeated ones too. Texts of any length are read whole, and a long one
makes a shard of its own. Scores are decimal divisions and do not overflow. Extra
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import arrow_rows, discard, materialize, slices, table
from graphfold.plans.ship import ship

LEAST, LONGEST, COVERED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Words after which a shard is full; a document is not divided.
SHARD = 1_500_000
#: Frequent words or phrases of a level that are broadcast at most.
SMALL = 400_000

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TOKENS = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
_WIDTHS = (np.uint8, np.uint16, np.uint32)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _lists(shard: int, lang: str, words: _Words, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The positions of each word as its first one and the steps to the next ones, in the narrowest type that holds them."""
    word = list(words)
    separator = np.fromiter((w[0] in _SEPARATORS for w in word), bool, len(word))
    keep = ~separator[ids]
    ids, at = ids[keep], at[keep]
    order = np.argsort(ids, kind="stable")
    ids, at = ids[order], at[order]
    start = np.flatnonzero(np.diff(ids, prepend=-1))
    if not len(start):
        return
    n = np.diff(start, append=len(ids))
    step = np.diff(at, prepend=0)
    first = at[start].copy()
    step[start] = 0
    most = np.maximum.reduceat(step, start)
    width = np.searchsorted([256, 65536], most, "right")
    kept, of = np.ones(len(ids), bool), np.repeat(width, n)
    kept[start] = False
    for w, kind in enumerate(_WIDTHS):
        lists = np.flatnonzero(width == w)
        if not len(lists):
            continue
        steps = step[kept & (of == w)].astype(kind)
        ends = np.concatenate([[0], np.cumsum((n[lists] - 1) * steps.itemsize)])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(steps)]).cast(pa.binary())
        names = pa.array([word[i] for i in ids[start[lists]]], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), shard)), pa.array([lang] * len(lists)), names, pa.array(first[lists]), pa.array(np.full(len(lists), w, np.int32)), packed, pa.array(n[lists])], names=_LIST)


_LIST = ["shard", "lang", "word", "first", "width", "steps", "n"]


def postings(docs: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """(shard, lang, word, first, width, steps, n): the positions of each word in each shard of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        held: dict[str, list[tuple[int, np.ndarray]]] = {}
        shard, position = TaskContext.get().partitionId() << 24, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                ids = np.concatenate([x for _, x in parts])
                at = np.concatenate([np.arange(a, a + len(x), dtype=np.int64) for a, x in parts])
                yield from _lists(shard, lang, words[lang], ids, at)

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    found = _TOKENS.findall(text.lower()) if text else None
                    if found:
                        of = words.setdefault(lang, _Words())
                        held.setdefault(lang, []).append((position, np.fromiter(map(of.__getitem__, found), np.int32, len(found))))
                        position += len(found) + 1  # no phrase goes on into the next document
                        if position >= shard_words:
                            yield from flush()
                            words, held, shard, position = {}, {}, shard + 1, 0
        yield from flush()

    kinds = [("shard", T.LongType()), ("lang", T.StringType()), ("word", T.StringType()), ("first", T.LongType()), ("width", T.IntegerType()), ("steps", T.BinaryType()), ("n", T.LongType())]
    return arrow_rows(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")), run, kinds)


def _positions(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of lists (id, first, width, steps, n) in order, and of all occurrences the word's place among them
    and the position."""
    width, each = lists.column("width").to_numpy(), lists.column("id").to_numpy()
    names = np.unique(each)
    ids, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for w, kind in enumerate(_WIDTHS):
        some = lists.select(["first", "steps", "n", "id"]).filter(pa.array(width == w))
        if not some.num_rows:
            continue
        n = some.column("n").to_numpy()
        start = np.cumsum(n) - n
        step = np.zeros(n.sum(), np.int32)
        later = np.ones(len(step), bool)
        later[start] = False
        step[later] = np.frombuffer(b"".join(some.column("steps").to_pylist()), kind)
        # at a list's start, from the end of the one before to its own first position
        first = some.column("first").to_numpy().astype(np.int32)
        last = first + np.add.reduceat(step, start, dtype=np.int32)
        step[start] = np.diff(first, prepend=0)
        step[start[1:]] = first[1:] - last[:-1]
        at.append(np.cumsum(step, dtype=np.int32))
        ids.append(np.repeat(np.searchsorted(names, some.column("id").to_numpy()).astype(np.int32), n))
    return names, np.concatenate(ids), np.concatenate(at)


def _extend(level: int, shared):
    """For the lists and the frequent phrases (level, a, b, id) of a shard, of 2 to level - 1 words: how often each of
    those of level - 1 words is followed by each word. a is the phrase without its last word, b that word. Levels with
    few frequent phrases come from `shared`, a broadcast, with all of them."""

    def run(lists: pa.Table, phrases: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if lists.num_rows:
            names, local, at = _positions(lists)
            word = np.full(int(at.max()) + level + 1, -1, np.int32)
            word[at] = local
            del local
            at = np.flatnonzero(word >= 0).astype(np.int32)
            # what[i] is the phrase that starts at at[i], by its place in labels
            what, of, labels = word[at], phrases.column("level").to_numpy(), names
            for k in range(2, level):
                some = phrases.filter(pa.array(of == k))
                a, b, id_ = shared.value.get(k) or (some.column(c).to_numpy() for c in ("a", "b", "id"))
                first, last = np.searchsorted(labels, a), np.searchsorted(names, b)
                here = (first < len(labels)) & (last < len(names))
                here[here] = (labels[first[here]] == a[here]) & (names[last[here]] == b[here])
                known, id_ = first[here] * len(names) + last[here], id_[here]
                labels, order = np.sort(id_), np.argsort(known)
                known, place_of = known[order], np.searchsorted(labels, id_[order]).astype(np.int32)
                later = word[at + (k - 1)]
                hit = later >= 0
                at, key = at[hit], what[hit].astype(np.int64) * len(names) + later[hit]
                place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                hit = known[place] == key if len(known) else np.zeros(len(key), bool)
                at, what = at[hit], place_of[place[hit]]
            # the last level - 1 words must be a frequent phrase too, which starts one word later
            goes_on = np.zeros(len(word), bool)
            goes_on[at] = True
            hit = goes_on[at + 1] & (word[at + (level - 1)] >= 0)
            key = what[hit].astype(np.int64) * len(names) + word[at[hit] + (level - 1)]
            del word, at, what, goes_on, hit
            key.sort()
            start = np.flatnonzero(np.diff(key, prepend=-1))
            n, key = np.diff(start, append=len(key)), key[start]
            found = [labels[key // len(names)], names[key % len(names)], n] if len(key) else found
        shard = lists.column("shard")[0].as_py() if lists.num_rows else 0
        pa.default_memory_pool().release_unused()
        return pa.table({"shard": pa.array(np.full(len(found[0]), shard, np.int64)), "a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "n": pa.array(found[2], pa.int64())})

    return run


def _sent(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows, which are counted; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= SMALL else df


@dataclass
class Phrases:
    """frequent (lang, phrase, words, f), and total (lang, n), the number of word occurrences."""

    frequent: DataFrame
    total: DataFrame


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD) -> Phrases:
    """All phrases of up to `longest` words that occur `least` times in docs (lang, text), within pieces."""
    spark = ship(docs.sparkSession)
    every = materialize(postings(docs, shard_words), "postings")
    counts = materialize(every.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(counts.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), "f"), "frequent_words")
    lists = materialize(every.join(_sent(words).select("id", "lang", F.col("phrase").alias("word")), ["lang", "word"]).select("shard", "id", "first", "width", "steps", "n"), "frequent_postings")
    discard(every)
    found, before = words.withColumn("words", F.lit(1)), words
    of_shard, few = spark.createDataFrame([], "shard long, level int, a long, b long, id long"), {}
    for level in range(2, longest + 1):
        grown = lists.groupBy("shard").cogroup(of_shard.groupBy("shard")).applyInArrow(_extend(level, spark.sparkContext.broadcast(few)), "shard long, a long, b long, n long")
        grown = materialize(grown, f"phrases_{level}")
        frequent = materialize(grown.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), f"frequent_{level}")
        named = frequent.join(before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head")), "a").join(words.select(F.col("id").alias("b"), F.col("phrase").alias("tail")), "b")
        before = materialize(named.select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"named_{level}")
        found = found.unionByName(before.withColumn("words", F.lit(level)))
        if level < longest and frequent.count() <= SMALL:
            few = few | {level: tuple(c.to_numpy() for c in frequent.select("a", "b", "id").toArrow().columns)}
        elif level < longest:
            met = grown.join(frequent.select("a", "b", "id"), ["a", "b"]).select("shard", F.lit(level).alias("level"), "a", "b", "id")
            of_shard = of_shard.unionByName(materialize(met, f"met_{level}"))
        discard(grown)
    discard(lists)
    return Phrases(found.drop("id"), total)


def rank(found: Phrases, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Each language's `top` phrases of two words or more by their weakest cut, without those that a longer candidate
    accounts for: lang, rank, phrase, a, l, r, n, score."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    f = found.frequent
    candidates = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(cast(a as decimal(28,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # each candidate's shorter parts of two words or more, with the frequency of the most frequent one around them
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inner = candidates.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(found.total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return rank(mine(table(spark, sf_dir, "documents")))
