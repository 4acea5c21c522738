"""Packing token sequences by minimum bin slack.

Every document is encoded, ended with a token, and cut if it is longer than a
sequence; the pieces are then packed into as few sequences as the method finds.
A sequence is filled as full as can be: it takes the longest piece that is left
and, by dynamic programming over bitsets of sums, those of the other lengths that
leave the least room. A filling is repeated as long as the pieces last, so what is
planned is the histogram of lengths, which has no more entries than a sequence has
tokens, whatever the number of documents. Its pieces are numbered within each
length, from the tasks that encoded them and the counts of the tasks before, and
the number says which filling a piece belongs to: nothing is gathered by length.

Ids are those of the tokenizers library. Texts are cut before blanks that precede
other than white space, where the vocabulary's pre-tokens always end, and a cut is
encoded once a task, by the vocabulary's ranks; a text that holds a special token
goes to the library whole. The tests compare the ids with the library's on every
code point.

Edge cases: a null text is an empty one, whose only piece is the end token. Rows
that repeat a doc_id, or that have none, are documents of their own. Texts of any
length are read whole. Extra columns do not matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from graphfold.llm.common import arrow_rows, materialize, slices, table, texts_of

TOKENS, END = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: Cuts that a task holds encoded, and the characters of the longest that it holds.
HELD, LONGEST = 500_000, 48

_CUT = re.compile(r" (?=\S)")


class _Ragged(Exception):
    pass


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings; None if its merges are not in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # byte-level vocabularies write printable bytes as they are, and the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}


class Encoder(dict):
    """Ids of whole texts as 32-bit little-endian bytes, as the library gives them without special tokens of its own. Holds
    those of what follows a blank."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # merges of a short text cost much less by ranks than by a call to the library
        ranks = _ranks(path)
        special = {s: self.library.token_to_id(s) for s in self.special}
        self.ids = self._by_library if ranks is None else tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}, special_tokens=special).encode_ordinary

    def _by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Ragged
        out = array("I", self.ids(f" {word}")).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self._by_library(text)).tobytes()
        try:
            first, *rest = text.split(" ")
            return array("I", self.ids(first)).tobytes() + b"".join(map(self.__getitem__, rest))
        except _Ragged:  # runs of white space stay whole
            first, *rest = _CUT.split(text)
            return array("I", self.ids(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def encode(docs: DataFrame, path: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids (32-bit little-endian bytes), and shard and place,
    which number the pieces of a length: the task that made it, and how many that task made before. Write them before
    they are read twice."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's
        encoder, made, shard = Encoder(path), np.zeros(tokens + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "text"):
                at, piece, start, ids = [], [], [], []
                for i, text in enumerate(texts_of(batch)):
                    b = encoder.encode(text) + np.array([END], "<u4").tobytes()
                    n = len(b) // 4
                    for k, lo in enumerate(range(-(-n % tokens), n, tokens)):
                        a = max(lo, 0)
                        at.append(i), piece.append(k), start.append(a), ids.append(b[4 * a : 4 * (lo + tokens)])
                length = np.array([len(x) // 4 for x in ids], np.int64)
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                place = np.empty(len(ids), np.int64)
                place[order] = made[length[order]] + np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
                made += np.bincount(length, minlength=tokens + 1)
                columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), shard, np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "shard", "place"])

    number = T.LongType()
    kinds = [("doc_id", docs.schema["doc_id"].dataType), ("piece", T.IntegerType()), ("start", number), ("length", number), ("ids", T.BinaryType()), ("shard", T.IntegerType()), ("place", number)]
    return arrow_rows(docs.select("doc_id", "text"), run, kinds)


@dataclass
class Filling:
    """Lengths with how many pieces of each one sequence takes, and how many sequences are filled so."""

    pieces: dict[int, int]
    times: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The longest length, and those of the others that fill up `room` best; of equally full ones, the longer lengths."""
    longest = max(counts)
    left = room - longest
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= left), reverse=True):
        copies, power = min(counts[length] - (length == longest), left // length), 1
        while copies > 0:
            power = min(power, copies)
            steps.append((length, power, reach))
            reach |= (reach << length * power) & ((2 << left) - 1)
            copies, power = copies - power, 2 * power
        if reach >> left & 1:
            break
    out, total = {longest: 1}, reach.bit_length() - 1
    for length, power, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + power
            total -= length * power
    return out


def plan(histogram: dict[int, int], room: int = TOKENS) -> list[Filling]:
    """Fillings for all pieces of a histogram of lengths (1 to room)."""
    counts, out = {x: n for x, n in histogram.items() if n}, []
    while counts:
        taken = fullest(counts, room)
        times = min(counts[x] // n for x, n in taken.items())
        out.append(Filling(taken, times))
        for x, n in taken.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


def place(pieces: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """pieces (written, with length, shard and place as encode() gives them) with sequence_id and offset instead of shard and place."""
    held = materialize(pieces.groupBy("length", "shard").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    by_length: dict[int, list[tuple[int, ...]]] = {}
    begun, sequence = dict.fromkeys(histogram, 0), 0
    for f in plan(histogram, tokens):
        offset = 0
        for length, n in f.pieces.items():
            by_length.setdefault(length, []).append((begun[length], sequence, f.times, offset))
            begun[length] += n * f.times
            offset += n * length
        sequence += f.times
    shared = pieces.sparkSession.sparkContext.broadcast({x: np.array(rows, np.int64).T for x, rows in by_length.items()})  # bounded by the fillings
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(held.select("length", "shard", F.coalesce(before, F.lit(0)).alias("__before")), ["length", "shard"]).withColumn("__rank", F.col("__before") + F.col("place")).drop("__before", "shard", "place")
    kept = [c for c in pieces.columns if c not in ("shard", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            of, at = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                hit = np.flatnonzero(length == x)
                first, number, times, offset = shared.value[int(x)]
                f = np.searchsorted(first, rank[hit], "right") - 1
                slot, row = np.divmod(rank[hit] - first[f], times[f])
                of[hit], at[hit] = number[f] + row, offset[f] + slot * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(of), pa.array(at)], names=[*kept, "sequence_id", "offset"])

    return arrow_rows(ranked.select(*kept, "__rank"), run, [*((c, pieces.schema[c].dataType) for c in kept), ("sequence_id", T.LongType()), ("offset", T.LongType())])


def pack(docs: DataFrame, path: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """The pieces of docs (doc_id, text) with their ids, sequence_id and offset: sorted by both, a sequence's ids are its
    pieces' one after another."""
    return place(materialize(encode(docs, path, tokens), "pieces"), tokens)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    pieces = encode(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(materialize(pieces, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
