"""N-gram Jaccard join with prefix filtering and a prefix-tree check.

All n-grams have one global order: rare ones first, by a count sketch over every
document, then by hash. Two sets with a similarity of at least t share an n-gram
among the first n - ceil(t * n) + 1 of each, so the lists of documents that share
a prefix n-gram give all candidates. The first n-gram that two sets share leaves
both no more to share than what follows it, so a posting's place bounds the sizes
that its document can be linked with there. Only postings with a partner in their
list that each other's bounds allow are kept: texts that share a template, but less
than they must, have their own n-grams first, and do not meet in its lists.

Groups of copies are contracted before anything is compared in full. In each of
STARS rounds every document is set against one hub, the same for most of a group,
and linked documents take one label. Lists that hold one label only are done with.
The documents of the other lists meet in blocks, named by a label, and are
compared wherever their labels differ. Rows grow with the postings, never with
the square of a group: a document has one row in a round of stars, and one in a
block for each label that shares a list with it. Blocks that are too large for a
task are dealt into chunks, where documents of the most common label do not meet.
Where many labels are left in such blocks, the classes that all links make so far
are the labels of further rounds of stars, so that what belongs together is one
label before chunks meet.

Within a block, parity bitmaps bound what two sets can share, and documents
without any partner left go. The others' ordered sets stand in a trie that is
walked with one of them after the other: sets with a common beginning share its
overlap, and a subtree is left as soon as the lengths that remain cannot reach the
needed overlap. Documents that are linked already need no further check, and a
block gives a link for each document at most, so pairs are never spelled out.

Sets are compared by 64-bit hashes of n-grams. Documents with equal sets form a
class first, and only the class takes part; the class's smallest id stands for it.

Edge cases: a text without words has an empty set, is linked with nothing and is
a component of its own; a null text counts as empty. Equal sets are linked.
Repeated rows with one id are one document. A row without an id keeps its set
size and has no component. Empty tables give empty results. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import arrow_rows, discard, materialize, slices, table, texts_of
from graphfold.llm.shingles import mix, shingle_sets
from graphfold.operators.components import connected_components

SKETCH_BITS, SKETCH_SLICES = 20, 64
#: Bits of a parity bitmap, and grams between two looks at the bound.
BITMAP_BITS, TRIE_STEP = 2048, 64
#: Documents of a chunk of a block or a star, and their grams on average at most; both bound what a task holds.
CHUNK, STAR_CHUNK, CHUNK_GRAMS = 1024, 512, 1024
#: Bits of the filter that keeps the sets of most other documents from being shuffled.
FILTER_BITS = 25
#: Rounds of stars before what is left is compared in full, and how many documents may hold a gram that is common.
STARS, COMMON = 2, 10_000
#: While chunks would repeat the rows of large blocks more than WIDE times on average, up to MORE further rounds come first.
MORE, WIDE = 3, 2


class Threshold:
    """Similarity of at least part / whole, in whole numbers."""

    def __init__(self, part: int = 85, whole: int = 100):
        self.part, self.whole = part, whole

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def overlap(self, n: int, m: int) -> int:
        """The least intersection of two similar sets."""
        return -(-self.part * (n + m) // (self.part + self.whole))

    def reach(self, n, left):
        """The largest set that is similar to one of n grams if it shares `left` of them; below n if none is that large."""
        return left * (self.part + self.whole) // self.part - n

    def largest(self, n):
        """The largest set that can be similar to a smaller one of n grams."""
        return self.whole * n // self.part


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold the n-grams of each of 2**SKETCH_BITS hash classes; the sums have a fixed size."""
    width = (1 << SKETCH_BITS) // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch, "text"):
                grams = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts_of(part), size)])
                got = np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                total = got if total is None else total + got
        if total is not None:
            rows = total.reshape(SKETCH_SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["slice", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"slice": group.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = arrow_rows(docs.select("text"), count, [("slice", T.IntegerType()), ("counts", T.BinaryType())])
    out = np.zeros((SKETCH_SLICES, width), np.int64)
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.reshape(-1), (1 << 32) - 1).astype(np.uint32)


def ordered(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    return grams[np.argsort(counts[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parities of the grams that fall on each bit. Two sets differ by as many grams as bits at least."""
    odd = np.bincount((grams & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prefixes(docs: DataFrame, counts, size: int, t: Threshold) -> DataFrame:
    """doc_id, n, a digest of the set, its prefix and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part), size)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                heads = [ordered(s, counts.value)[: t.prefix(len(s))].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "prefix", "bits"],
                )

    return arrow_rows(docs.select("doc_id", "text"), run, [("doc_id", T.LongType()), ("n", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("prefix", T.ArrayType(T.LongType())), ("bits", T.BinaryType())])


POSTING = [("gram", T.LongType()), ("n", T.LongType()), ("id", T.LongType()), ("reach", T.LongType())]


def postings(own: DataFrame, counts, common: int, t: Threshold) -> DataFrame:
    """(gram, n, id, reach, common) of all prefixes of own (id, n, prefix). reach: the largest partner, if gram is the first
    that is shared; common: more than so many documents may hold the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            starts = lists.offsets.to_numpy()
            sizes = np.diff(starts)
            grams = lists.flatten().to_numpy()
            often = counts.value[(grams.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > common
            n, ids = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("n", "id"))
            place = np.arange(len(grams)) - np.repeat(starts[:-1] - starts[0], sizes)
            columns = [pa.array(x) for x in (grams, n, ids, t.reach(n, n - place), often)]
            for lo in range(0, len(grams), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 1 << 16) for c in columns], names=[*(c for c, _ in POSTING), "common"])

    return arrow_rows(own.select("id", "n", "prefix"), run, [*POSTING, ("common", T.BooleanType())])


def _bucket(t: Threshold) -> Column:
    """Sizes in classes, such that similar sets lie in one or in two that follow each other."""
    return F.floor(F.log("n") / math.log(t.whole / t.part))


def _reached(rows: DataFrame, t: Threshold) -> DataFrame:
    """The postings of common grams that a smaller or equal set reaches, and those that reach one of their own size."""
    own = rows.withColumn("bucket", _bucket(t))
    first = own.where("reach >= n").groupBy("gram", "bucket").agg(F.max("reach").alias("far"), F.min("n").alias("low"))
    # one more class than sizes need, as logarithms are rounded
    first = first.select("gram", F.explode(F.array(*(F.col("bucket") + k for k in range(3)))).alias("bucket"), "far", "low")
    first = first.groupBy("gram", "bucket").agg(F.max("far").alias("far"), F.min("low").alias("low"))
    return own.join(first.hint("merge"), ["gram", "bucket"]).where("n <= far and low <= reach").select(*(c for c, _ in POSTING))


def lists(rows: DataFrame, t: Threshold) -> DataFrame:
    """The postings (gram, n, id, reach) that may have a partner in their list: two sets whose first common gram it is each
    lie within the other's reach.

    In order of size, a posting has a larger partner if the next one lies within its reach, and a smaller one if one
    before it reaches it, and it the smallest of these. Those of common grams need not meet in a task: they are set
    against what aggregations know of their list.
    """
    base = np.int64(1 << 40)  # above all sizes; batches have fewer rows than 2**23

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row as a batch of one, whether it has a smaller partner, and what is known of its list
        for batch in batches:
            if not batch.num_rows:
                continue
            before, far, low = 0, 0, base - 1
            if held:
                last, near, far, low = held
                batch, before = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0], 1
            gram, n, reach = (batch.column(c).to_numpy() for c in ("gram", "n", "reach"))
            same = gram[1:] == gram[:-1]
            part = np.concatenate([[0], np.cumsum(~same)]) * base
            first = reach >= n
            # the farthest reach and the least size of the earlier rows of a list that reach their own size
            fars, lows = np.where(first, reach, 0), np.where(first, base - 1 - n, 0)
            if before:
                fars[0], lows[0] = far, base - 1 - low
            fars, lows = (np.maximum.accumulate(x + part) - part for x in (fars, lows))
            smaller = np.zeros(len(n), bool)
            smaller[1:] = same & (n[1:] <= fars[:-1]) & (base - 1 - lows[:-1] <= reach[1:])
            if before:
                smaller[0] = near
            keep = smaller.copy()
            keep[:-1] |= same & (n[1:] <= reach[:-1])
            keep[-1] = False
            held = batch.slice(len(n) - 1), bool(smaller[-1]), int(fars[-1]), int(base - 1 - lows[-1])
            if keep.any():
                yield batch.filter(pa.array(keep))
        if held and held[1]:
            yield held[0]

    names = [c for c, _ in POSTING]
    kept = arrow_rows(rows.where("not common").select(*names).repartition(F.col("gram")).sortWithinPartitions("gram", "n", "id"), run, POSTING)
    return kept.unionByName(_reached(rows.where("common").select(*names), t))


def _labelled(table_: DataFrame, labels: DataFrame | None) -> DataFrame:
    """table_ with the class of each id (`label`); ids without one are classes of their own."""
    if labels is None:
        return table_.withColumn("label", F.col("id"))
    return table_.join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _stars(table_: DataFrame, t: Threshold, turn: int) -> DataFrame:
    """(hub, id, n, label) from lists (gram, n, id, reach, label): one hub for each document that shares a list with one of
    another label and like size that its reach allows, and the hubs themselves.

    A list's hub is its document with the smallest hash, which most lists of a group of copies have in common, among those
    that reach documents of their own size, if there are any. Where it is out of reach, the farthest reaching document of
    the next smaller sizes takes its place. A document takes the hub of its list with the smallest hash.
    """
    own = table_.withColumn("bucket", _bucket(t))
    one = F.struct("id", "n", "label", "reach")
    near = F.min(F.struct((F.col("reach") < F.col("n")).alias("late"), F.xxhash64("id", F.lit(turn)).alias("h"), one.alias("hub")))["hub"]
    far = F.max(F.struct("reach", F.xxhash64("id", F.lit(turn)).alias("h"), one.alias("hub")))["hub"]
    hubs = own.groupBy("gram", "bucket").agg(near.alias("near"), far.alias("far"), F.min("label").alias("low"), F.max("label").alias("high"))
    none = F.lit(None).cast(hubs.schema["near"].dataType)
    places = F.array(F.struct("bucket", "near", none.alias("far")), F.struct((F.col("bucket") + 1).alias("bucket"), none.alias("near"), "far"))
    hubs = hubs.select("gram", F.explode(places).alias("at"), "low", "high").groupBy("gram", "at.bucket")
    hubs = hubs.agg(F.max("at.near").alias("near"), F.max("at.far").alias("far"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("low", "high")
    fits = lambda hub: (F.col("label") != F.col(f"{hub}.label")) & (F.col("n") <= F.col(f"{hub}.reach")) & (F.col(f"{hub}.n") <= F.col("reach"))
    first = own.join(hubs.hint("merge"), ["gram", "bucket"]).withColumn("hub", F.when(fits("near"), F.col("near")).when(fits("far"), F.col("far"))).where("hub is not null")
    first = first.groupBy("id", "n", "label").agg(F.min(F.struct(F.xxhash64("gram", F.lit(turn)).alias("h"), F.struct("hub.id", "hub.n", "hub.label").alias("hub"))).alias("one"))
    members = first.select(F.col("one.hub").alias("hub"), F.struct("id", "n", "label").alias("x"))
    both = members.select(F.col("hub.id").alias("hub"), F.explode(F.array("x", F.struct("hub.id", "hub.n", "hub.label"))).alias("x"))
    return both.select("hub", "x.*").distinct()


def _blocks(table_: DataFrame) -> DataFrame:
    """(hub, id, n, label): all documents of lists that hold several labels, in blocks that are named by a list's least
    label, so that the lists of a group of copies make one block. Two documents of a list with different labels meet."""
    names = table_.groupBy("gram").agg(F.min("label").alias("hub"), F.max("label").alias("high")).where("hub < high").select("gram", "hub")
    return table_.join(names.hint("merge"), "gram").select("hub", "id", "n", "label").distinct()


def _chunks(rows: str, grams: str, most: int) -> Column:
    """How many chunks so many documents and grams fill."""
    count = lambda c, room: F.ceil(F.expr(c) / F.lit(float(room)))
    return F.greatest(count(rows, most), count(grams, most * CHUNK_GRAMS)).cast("int")


def _sums() -> tuple[Column, Column]:
    return F.count("*").alias("rows"), F.sum("n").alias("grams")


def _star_parts(rows: DataFrame) -> DataFrame:
    """Stars (hub, id, n, label) with a part: of a small star 0. A larger star is dealt into chunks, and its hub goes to each.

    Only the large stars, of which there are few, are looked up: Spark broadcasts them while their table is small.
    """
    large = materialize(rows.groupBy("hub").agg(*_sums()).select("hub", _chunks("rows", "grams", STAR_CHUNK).alias("k")).where("k > 1"), "join_large")
    own = rows.join(large, "hub", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    return own.withColumn("part", F.explode(F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(mine))).drop("k")


def _large(rows: DataFrame) -> DataFrame:
    """The blocks of more than one chunk: hub, the most common label, the chunks of its documents (b) and of the others (o),
    the rows, and the rows that chunks make of them (dealt)."""
    by_label = rows.groupBy("hub", "label").agg(*_sums())
    large = by_label.groupBy("hub").agg(F.max(F.struct("rows", "label", "grams")).alias("top"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))
    large = large.where(_chunks("rows", "grams", CHUNK) > 1)
    large = large.select("hub", F.col("top.label").alias("most"), "rows", "top", _chunks("top.rows", "top.grams", CHUNK).alias("b"), _chunks("rows - top.rows", "grams - top.grams", CHUNK).alias("o"))
    return materialize(large.select("hub", "most", "b", "o", "rows", F.expr("(rows - top.rows) * (o + b) + top.rows * o").alias("dealt")), "join_large")


def _wide(large: DataFrame) -> bool:
    rows, dealt = large.agg(F.sum("rows"), F.sum("dealt")).collect()[0]
    return (dealt or 0) > WIDE * (rows or 0)


def _block_parts(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Blocks (hub, id, n, label) with a part: of a small block 0. The others (_large()) are dealt into chunks.

    The documents of the most common label are set against chunks of the others, and these against each other; those of
    the most common label never meet.
    """
    own = rows.join(large.select("hub", "most", "b", "o"), "hub", "left")
    # part x * (o + b) + y: chunk x of the others beside chunk y of the others (y >= x) or chunk y - o of the most common label
    wide, at = F.col("o") + F.col("b"), lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    common = F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda x: x * wide + F.col("o") + at(F.col("b")))
    mine = at(F.col("o"))
    other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda y: F.least(y, mine) * wide + F.greatest(y, mine)),
        F.transform(F.sequence(F.col("o"), wide - 1), lambda y: mine * wide + y),
    )
    part = F.when(F.col("o").isNull(), F.array(F.lit(0))).when(F.col("label") == F.col("most"), common).otherwise(other)
    return own.withColumn("part", F.explode(part)).select("hub", "part", "id", "n", "label")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, with their other columns."""
    now, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield now, rows


def _may_link(n: np.ndarray, bits: np.ndarray, label: np.ndarray, i: int, t: Threshold) -> np.ndarray:
    """Later rows (sorted by size) of another label whose size and bitmap allow a link with row i."""
    stop = int(np.searchsorted(n, t.largest(int(n[i])), side="right"))
    js = i + 1 + np.flatnonzero(label[i + 1 : stop] != label[i])
    if not len(js):
        return js
    least = -(-t.part * (n[i] + n[js]) // (t.part + t.whole))
    differ = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return js[differ <= n[i] + n[js] - 2 * least]


def _hopeful(parts: DataFrame, signs: DataFrame, t: Threshold) -> DataFrame:
    """The rows of parts (hub, part, id, n, label) with a partner of another label that their bitmaps allow."""
    kinds = [("hub", T.LongType()), ("part", T.IntegerType()), ("id", T.LongType()), ("n", T.LongType()), ("label", T.LongType())]
    rows = parts.join(signs.hint("merge"), "id").select(*(n for n, _ in kinds), "bits").repartition(F.col("hub"), F.col("part")).sortWithinPartitions("hub", "part", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, part), some in _runs(batches, 2):
            ids, n, label = ([r[k] for r in some] for k in range(3))
            n, label = np.array(n, np.int64), np.array(label, np.int64)
            bits = np.frombuffer(b"".join(r[3] for r in some), np.uint64).reshape(len(some), -1)
            good = np.zeros(len(some), bool)
            for i in range(len(some) - 1):
                js = _may_link(n, bits, label, i, t)
                good[js] = True
                good[i] |= len(js) > 0
            at = np.flatnonzero(good).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([hub] * len(at), pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array([ids[k] for k in at], pa.int64()), pa.array(n[at]), pa.array(label[at])], names=[n for n, _ in kinds])

    return arrow_rows(rows, run, kinds)


def trie_join(hub: np.ndarray, members: list[np.ndarray], t: Threshold) -> np.ndarray:
    """Which members are similar to hub. The members, sorted, are the paths of a trie: each begins with what it shares
    with the one before, and takes over the overlaps counted there."""
    table_, n = np.sort(hub), len(hub)
    order = sorted(range(len(members)), key=lambda i: members[i].tobytes())
    out = np.zeros(len(members), bool)
    path, seen = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # seen[d]: overlap of the first d grams of the path
    for i in order:
        s = members[i]
        m, need = len(s), t.overlap(n, len(s))
        both = min(len(path), m)
        differ = np.flatnonzero(path[:both] != s[:both])
        depth = min(int(differ[0]) if len(differ) else both, len(seen) - 1)
        seen, path = seen[: depth + 1], s
        while depth < m and seen[depth] + min(m - depth, n - seen[depth]) >= need:
            block = s[depth : depth + TRIE_STEP]
            at = np.minimum(np.searchsorted(table_, block), n - 1)
            seen = np.concatenate([seen, seen[-1] + np.cumsum(table_[at] == block)])
            depth += len(block)
        out[i] = depth == m and seen[depth] >= need
    return out


def _links(parts: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(src, dst) from parts (hub, part, id, n, label): links between labels that join each part's documents as far as
    links do; one for each document at most, to the document of its class in the part that comes first."""
    rows = parts.join(sets.hint("merge"), "id").select("hub", "part", "n", "id", "label", "grams").repartition(F.col("hub"), F.col("part")).sortWithinPartitions("hub", "part", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _runs(batches, 2):
            n, ids = np.array([r[0] for r in some], np.int64), [r[1] for r in some]
            sets_ = [np.frombuffer(r[3], np.uint64) for r in some]
            bits = np.stack([bitmap(s) for s in sets_])
            _, label = np.unique([r[2] for r in some], return_inverse=True)
            src, dst = [], []
            for i in range(len(some) - 1):
                js = _may_link(n, bits, label, i, t)
                if not len(js):
                    continue
                for j in js[trie_join(sets_[i], [sets_[k] for k in js.tolist()], t)].tolist():
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        src.append(ids[i])
                        dst.append(ids[j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return arrow_rows(rows, run, [("src", T.LongType()), ("dst", T.LongType())]).distinct()


def _slot(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, gathered as at most 2**FILTER_BITS / 64 words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for batch in batches:
            at = _slot(batch.column("id").to_numpy())
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["word", "bits"])

    got = arrow_rows(ids, words, [("word", T.LongType()), ("bits", T.LongType())]).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _slot(ids)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _relabelled(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, label) after more links: a document takes the least label among its own and its partners'. Labels may be finer
    than the classes that links make; documents of one label always belong to one class."""
    both = links.union(links.select("dst", "src")).toDF("id", "other")
    other = _labelled(both.select(F.col("other").alias("id"), F.col("id").alias("of")), labels).select(F.col("of").alias("id"), "label")
    own = both.select("id", F.col("id").alias("label")) if labels is None else labels.select("id", "label")
    return other.unionByName(own).groupBy("id").agg(F.min("label").alias("label"))


def _sets(docs: DataFrame, wanted: DataFrame, counts, size: int) -> DataFrame:
    """(id, grams) of the wanted documents (id), in the global order. A filter keeps most other documents from being
    read further, and those that pass it by chance go with the join."""
    asked = docs.sparkSession.sparkContext.broadcast(_filter(wanted))  # 2**FILTER_BITS bits for any corpus

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
                part = part.take(pa.array(known[_passes(ids.take(pa.array(known)).to_numpy(), asked.value)]))
                if not part.num_rows:
                    continue
                sets = shingle_sets(texts_of(part), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([ordered(s, counts.value).tobytes() for s in sets], pa.binary())], names=["id", "grams"])

    sets = arrow_rows(docs, full, [("id", T.LongType()), ("grams", T.BinaryType())])
    return sets.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"])


def join(docs: DataFrame, size: int = 4, t: Threshold | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs (doc_id, text)."""
    t = t or Threshold()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = sketch(docs, size)
    counts, common = spark.sparkContext.broadcast(seen), int(max(COMMON, 64 * float(seen.mean())))  # 2**SKETCH_BITS counters for any corpus
    found = materialize(prefixes(docs, counts, size, t), "join_prefixes")
    some = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "join_classes")
    own = materialize(some.join(classes.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n", "prefix", "bits"), "join_own")
    sizes = materialize(found.select("doc_id", "n", "d1", "d2"), "join_sizes")
    discard(found)
    shared = materialize(lists(postings(own, counts, common, t), t), "join_lists")
    wanted = materialize(shared.select("id").distinct(), "join_wanted")
    signs = materialize(own.join(wanted.hint("merge"), "id", "left_semi").select("id", "bits"), "join_signs")
    discard(own)

    labels, links, turn, star = None, [], 0, True
    while star:
        table_ = _labelled(shared, labels)
        if turn >= STARS:
            blocks = materialize(_blocks(table_), "join_blocks")
            large = _large(blocks)
            star = turn < STARS + MORE and _wide(large)
        rows = _star_parts(materialize(_stars(table_, t, turn), "join_stars")) if star else _block_parts(blocks, large)
        parts = materialize(_hopeful(rows, signs, t), "join_hopeful")
        sets = materialize(_sets(docs, parts.select("id").distinct(), counts, size), "join_sets")
        links.append(materialize(_links(parts, sets, t), "join_links"))
        for done in (parts, sets):
            discard(done)
        turn += 1
        if star and turn <= STARS:
            # the first pass takes the least label to the middle of a star, the second to all that are linked with it
            for _ in range(2):
                labels = materialize(_relabelled(links[-1], labels), "join_labels")
        elif star:
            labels = materialize(connected_components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("id"), F.col("component").alias("label")), "join_labels")
    for done in (shared, signs):
        discard(done)
    final = connected_components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "id")
    known = classes.join(final, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    known = materialize(known, "join_known")
    # texts without words have no class and need not meet
    worded = sizes.where("n > 0").join(known.hint("merge"), ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return worded.unionByName(sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with __id, and the rows without a doc_id (a table of its own, null if there are none) with numbers for __id that no doc_id has."""
    given = docs.where(F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long"))
    loose = docs.where(F.col("doc_id").isNull())
    if loose.isEmpty():
        return given, None
    loose = materialize(loose.withColumn("__k", F.monotonically_increasing_id()), "join_loose")
    # the numbers of each partition, made to follow one another: a row for each partition
    starts, n = [], 0
    for r in loose.groupBy(F.shiftright("__k", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((r["p"], n))
        n += r["n"]
    low, high = given.agg(F.min("__id"), F.max("__id")).collect()[0]
    # above all ids, so that documents with an id go first; below them where there is no room
    first = 0 if high is None else high + 1 if high + n < 1 << 63 else low - n
    starts = docs.sparkSession.createDataFrame(starts, "__p long, __start long")
    own = loose.withColumn("__p", F.shiftright("__k", 33)).join(F.broadcast(starts), "__p")
    own = own.withColumn("__id", F.col("__start") + F.col("__k").bitwiseAND((1 << 33) - 1) + first)
    return given, own.select(*docs.columns, "__id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates (five words, 0.8).

    One row of each kept id stays: rows that repeat an id go. Rows without an id are documents of their own, compared
    like all others: one stays if it is no near duplicate of a document with an id, and one of each group of them. Texts
    without words are near duplicates of nothing, with an id or without.
    """
    given, loose = _numbered(docs)
    every = given if loose is None else given.unionByName(loose)
    groups = join(every.select(F.col("__id").alias("doc_id"), "text"), 5, Threshold(80, 100)).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    groups = materialize(groups, "join_kept")
    return every.join(groups.hint("merge"), "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)
