"""Suffix-array dedup: bytes that a long match with an earlier document covers.

A byte goes if a string of LENGTH bytes over it also starts in a document with a
smaller id. Work is cut into batches of consecutive documents and shards of
strings, and every shard holds a logarithmic family of suffix arrays:

1. Each string of LENGTH bytes has an anchor, the least of its GRAM-byte grams by
   hash, so that equal strings have equal anchors. Grams that are anchors in one
   document only are found by a shuffle of 48-bit hashes (equal hashes of unequal
   grams only add work), and their strings are done with.
2. The strings around the other anchors go to the anchor's shard, as the bytes of
   each anchor's reach. Batches come in the order of ids. A batch gets a suffix
   array, sorted by bytes up to LENGTH, which is scanned against the arrays of all
   existing levels, in the order that both share, and within itself for matches of
   LENGTH bytes; what is new becomes a level of its own, and levels of like size
   are merged, so there are logarithmically many.
3. The matches go back to their documents, which are cut.

Suffixes are compared by their bytes. Equal reaches within a batch are sent once,
for the smallest id, and a reach that an earlier batch has had is settled without
a scan; this keeps a group of copies, however large, from any one shard. A batch is a range of ids, of which there are at most MOST_RANGES, and the
texts of a range are read in as many parts as their bytes ask for.

Edge cases: a null text counts as empty; texts shorter than LENGTH bytes keep all
bytes. Rows with one id never match each other. A row without an id keeps its
bytes and removes none elsewhere. Empty tables give empty results. Overlapping
matches count once; strings are judged on the input. Texts of any length are read
whole. Extra columns do not matter.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import arrow_rows, materialize, slices, table, texts_of
from graphfold.llm.shingles import mix

LENGTH, GRAM = 50, 26
#: Bytes of text in a batch, and strings' bytes for a shard, on average.
BATCH_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
#: Ranges of ids; beyond so many batches, those of a range share it.
MOST_RANGES = 1 << 16
#: Bytes whose anchors are found at once; the arrays for it take about a hundred times as much.
PIECE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (7, 11)]
_CACHE: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _CACHE.get(name)
    if got is None or len(got) < n:
        got = np.empty(n + n // 4 + 1, np.uint64)
        got[0] = 1
        got[1:] = base
        _CACHE[name] = got = np.cumprod(got)
    return got[:n]


def rolling(flat: np.ndarray, width: int, which: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the strings of `width` bytes at each place, or at the places `at`."""
    n = len(flat)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[which][flat] * _powers("up", _P, n), out=sums[1:])
    down = _powers("down", _INVERSE, n)
    if at is None:
        return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])
    return mix((sums[at + width] - sums[at]) * down[at])


def reaches(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, document, first string, number of strings, anchor hash) of each anchor; places are in flat."""
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return flat, empty, empty, empty, np.zeros(0, np.uint64)
    h = rolling(flat, GRAM)
    bits = np.uint64(int(len(h)).bit_length())
    best = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    anchor = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(len(flat) + 1, np.int64)
    long = sizes >= LENGTH
    inside[starts[long]] += 1
    np.subtract.at(inside, (starts + sizes - LENGTH + 1)[long], 1)
    q = np.flatnonzero(np.cumsum(inside)[: len(anchor)])
    a = anchor[q]
    doc = np.repeat(np.arange(len(raw)), sizes)[q]
    cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])) if len(q) else empty
    return flat, doc[cut], q[cut], np.diff(np.concatenate([cut, [len(q)]])), h[a[cut]] >> np.uint64(16)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _pack_hashes(h: np.ndarray) -> bytes:
    """48-bit hashes in six bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids by their differences, which repeat where documents do."""
    return zlib.compress(_bytes(np.diff(ids, prepend=np.int64(0))), 1)


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int64))


def _ranges_before(bounds: np.ndarray, key: Column) -> Column:
    """How many of the rising bounds are at most key: over runs of bounds first, then within one run."""
    step = max(1, math.isqrt(len(bounds)))
    runs = [bounds[i : i + step].tolist() for i in range(0, len(bounds), step)]
    if not runs:
        return F.lit(0)
    table_ = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
    run = F.size(F.filter(table_([r[0] for r in runs], "array<bigint>"), lambda b: b <= key))
    own = F.size(F.filter(F.element_at(table_(runs, "array<array<bigint>>"), F.greatest(run, F.lit(1))), lambda b: b <= key))
    return F.when(run == 0, 0).otherwise((run - 1) * step + own)


def _slots(ids: np.ndarray, bounds: np.ndarray, each: int) -> np.ndarray:
    """Batch and part of documents in one number."""
    return np.searchsorted(bounds, ids, side="right") * each + np.mod(ids, each)


def _repeated(docs: DataFrame, bounds: np.ndarray, shards: int, each: int, partitions: int) -> DataFrame:
    """(slot, docs, hashes): the anchors of documents that are anchors elsewhere too."""
    parts = [("shard", T.IntegerType()), ("slot", T.LongType()), ("docs", T.BinaryType()), ("hashes", T.BinaryType()), ("known", T.BinaryType())]
    names = [n for n, _ in parts]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                ids = part.column("doc_id").to_numpy()
                _, doc, _, _, h = reaches([t.encode("utf-8", "surrogatepass") for t in texts_of(part)])
                if not len(h):
                    continue
                doc = ids[doc]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                group = np.cumsum(new) - 1
                many = np.bincount(group, once) > 1  # in several documents of this slice
                known = many[group]
                shard = (h % np.uint64(shards)).astype(np.int64)
                rows = []
                # what the slice knows by itself goes to the batches through shard 0 and up, as it is
                here = known & once
                home = _slots(doc, bounds, each)
                for b in np.unique(home[here]).tolist():
                    at = here & (home == b)
                    some = np.argsort(doc[at], kind="stable")
                    rows.append((b % shards, b, _pack_ids(doc[at][some]), _pack_hashes(h[at][some]), None))
                order = np.lexsort((doc[new], shard[new]))
                s, hs, ds, ks = shard[new][order], h[new][order], doc[new][order], known[new][order]
                cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows.append((int(s[x]), -1, _pack_ids(ds[x:y]), _pack_hashes(hs[x:y]), zlib.compress(_bytes(ks[x:y]), 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, h, known = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            doc, h, known = doc[order], h[order], known[order]
            same = h[1:] == h[:-1]
            hit = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & ~known
            yield from pack(doc[hit], h[hit])

        def pack(doc: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            home = _slots(doc, bounds, each)
            order = np.lexsort((doc, home))
            home, doc, h = home[order], doc[order], h[order]
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else []
            rows = [(int(home[x]), _pack_ids(doc[x:y]), _pack_hashes(h[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["slot", "docs", "hashes"])

        for batch in batches:
            for shard, home, d, h, known in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != now:
                    yield from found()
                    now = shard
                doc, h = _unpack_ids(d), _unpack_hashes(h)
                if home >= 0:
                    yield from pack(doc, h)
                else:
                    held.append((doc, h, np.frombuffer(zlib.decompress(known), bool)))
        yield from found()

    sent = arrow_rows(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), send, parts)
    return arrow_rows(sent.repartition(partitions, "shard").sortWithinPartitions("shard"), meet, [("slot", T.LongType()), ("docs", T.BinaryType()), ("hashes", T.BinaryType())])


WORDS = -(-LENGTH // 8)
#: The bits of a string's last word that belong to its first LENGTH bytes.
_LAST = np.uint64(((1 << 64) - 1) ^ ((1 << 8 * (8 * WORDS - LENGTH)) - 1))


class Suffixes:
    """A suffix array: places in flat whose strings of LENGTH bytes rise. flat has 8 bytes more than its strings."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, head: np.ndarray | None = None):
        self.flat, self.at = flat, at
        self.head = self.word(0, slice(None)) if head is None else head

    def word(self, j: int, which) -> np.ndarray:
        """Bytes 8 j to 8 j + 8 of the chosen strings, as numbers in the order of the bytes."""
        return words_at(self.flat, self.at[which], j)

    def __len__(self) -> int:
        return len(self.at)

    def part(self, which: np.ndarray) -> Suffixes:
        """The chosen suffixes over the same bytes."""
        return Suffixes(self.flat, self.at[which], self.head[which])

    def only(self, keep: np.ndarray) -> Suffixes:
        """The chosen suffixes, with the bytes of flat that they need."""
        at = self.at[keep]
        edge = np.bincount(at, minlength=len(self.flat)) - np.bincount(at + LENGTH, minlength=len(self.flat))
        used = np.cumsum(edge) > 0
        place = np.cumsum(used) - 1
        return Suffixes(np.concatenate([self.flat[used], np.zeros(8, np.uint8)]), place[at], self.head[keep])


def words_at(flat: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    every = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
    got = every[at + 8 * j].astype(np.uint64)
    return got & _LAST if j == WORDS - 1 else got


def suffix_array(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of LENGTH bytes at `at`, and which of them, in that order, differ from the one before.
    Strings are sorted by their first word; those that tie, by the next, until none ties."""
    head = words_at(flat, at, 0)
    order = np.argsort(head)
    head = head[order]
    new = np.concatenate([np.ones(min(1, len(at)), bool), head[1:] != head[:-1]])
    for j in range(1, WORDS):
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        rows, group = order[tied], np.cumsum(new)[tied]
        word = words_at(flat, at[rows], j)
        by = np.argsort(word)
        by = by[np.argsort(group[by] * len(by) + np.arange(len(by)))]
        order[tied] = rows[by]
        word, group = word[by], group[by]
        new[tied[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
    return order, new


def _compare(a: Suffixes, i: np.ndarray, b: Suffixes, k: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as a's string is less than, equal to or greater than b's, whose first words are equal."""
    out, left = np.zeros(len(i), np.int8), np.arange(len(i))
    for j in range(1, WORDS):
        x, y = a.word(j, i[left]), b.word(j, k[left])
        out[left] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
        left = left[x == y]
        if not len(left):
            break
    return out


def scan(a: Suffixes, b: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of b, both sorted: its place in a, and whether a has it. The first words are merged; where they
    agree, the place is searched among a's strings with that first word."""
    place = np.searchsorted(a.head, b.head)
    hit = np.zeros(len(b), bool)
    live = np.flatnonzero(a.head[np.minimum(place, len(a) - 1)] == b.head) if len(a) else np.zeros(0, np.int64)
    low, high = place[live], np.searchsorted(a.head, b.head[live], "right")
    while len(live):
        mid = (low + high) >> 1
        sign = _compare(a, mid, b, live)
        hit[live[sign == 0]] = True
        low, high = np.where(sign < 0, mid + 1, low), np.where(sign < 0, high, mid)
        place[live] = np.where(sign == 0, mid, low)
        go = (sign != 0) & (low < high)
        live, low, high = live[go], low[go], high[go]
    return place, hit


class Levels:
    """A logarithmic family of suffix arrays over distinct strings, the largest first."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def scan(self, b: Suffixes) -> np.ndarray:
        """Which suffixes of b stand in some level; the levels are scanned in turn for those that none has had."""
        left = np.arange(len(b))
        for a in self.levels:
            left = left[~scan(a, b.part(left))[1]]
        out = np.ones(len(b), bool)
        out[left] = False
        return out

    def add(self, b: Suffixes) -> None:
        """A new level of strings that no level holds; while the one before is not twice as large, the two are merged."""
        if not len(b):
            return
        self.levels.append(b)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            a, b = self.levels.pop(-2), self.levels.pop()
            behind = scan(a, b)[0] + np.arange(len(b))
            at, head = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint64)
            from_b = np.zeros(len(at), bool)
            from_b[behind] = True
            at[from_b], at[~from_b] = b.at + len(a.flat) - 8, a.at
            head[from_b], head[~from_b] = b.head, a.head
            self.levels.append(Suffixes(np.concatenate([a.flat[:-8], b.flat]), at, head))

    def batch(self, doc: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which strings of a batch match one of a smaller document, in a level or in the batch; then adds the batch."""
        if not len(at):
            return np.zeros(0, bool)
        flat = np.concatenate([flat, np.zeros(8, np.uint8)])
        order, new = suffix_array(flat, at)
        first, group, d = np.flatnonzero(new), np.cumsum(new) - 1, doc[order]
        mine = Suffixes(flat, at[order[first]])
        seen = self.scan(mine)
        out = np.empty(len(doc), bool)
        out[order] = seen[group] | (d > np.minimum.reduceat(d, first)[group])
        self.add(mine.only(~seen))
        return out


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """The documents with their slot, (slot, docs, starts, ends): packed byte spans to remove, which may overlap, and the
    number of partitions that their bytes ask for."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    batches, shards = max(1, -(-size // BATCH_BYTES)), max(1, -(-size // SHARD_BYTES))
    cuts = min(batches, MOST_RANGES)
    each = -(-batches // cuts)  # parts of a range
    parts = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], max(20_000, 4 * cuts)).alias("b")).collect()[0]["b"] if cuts > 1 else None
    bounds = np.unique(np.array(got or [], np.int64))
    slot = _ranges_before(bounds, F.col("doc_id")).cast("long") * each + F.pmod("doc_id", F.lit(each).cast("long"))
    docs = docs.withColumn("slot", F.when(F.col("doc_id").isNotNull(), slot).otherwise(-1 - (F.crc32("text") % cuts)))
    repeated = materialize(_repeated(docs, bounds, shards, each, parts), "dedup_anchors")
    names = ["shard", "batch", "docs", "starts", "counts", "bytes"]

    def gather(texts: pa.Table, marks: pa.Table) -> pa.Table:
        """The reaches of repeated anchors of a batch, by shard; counts is null for spans that are settled already."""
        rows: list[tuple] = []
        if texts.num_rows and marks.num_rows:
            md = np.concatenate([_unpack_ids(x) for x in marks.column("docs").to_pylist()])
            mh = np.concatenate([_unpack_hashes(x) for x in marks.column("hashes").to_pylist()])
            marked = np.unique(mix(mh + mix(md.view(np.uint64))))
            order = np.argsort(texts.column("doc_id").to_numpy(), kind="stable")
            found: list[tuple[np.ndarray, ...]] = []  # document, place in it, strings, shard, whether it is sent
            sent_reaches: list[bytes] = []
            first: dict[bytes, int] = {}
            for part in slices(texts.take(pa.array(order)).combine_chunks().to_batches()[0], "text", PIECE_BYTES):
                ids = part.column("doc_id").to_numpy()
                raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(part)]
                starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                flat, doc, q, n, h = reaches(raw)
                key = mix(h + mix(ids[doc].view(np.uint64)))
                at = np.minimum(np.searchsorted(marked, key), len(marked) - 1)
                keep = np.flatnonzero(marked[at] == key)
                joined, d, x, c = flat.tobytes(), ids[doc[keep]], q[keep], n[keep]
                mine = [joined[i:j] for i, j in zip(x.tolist(), (x + c + LENGTH - 1).tolist(), strict=True)]
                new = np.fromiter((first.setdefault(r, i) >= i for r, i in zip(mine, d.tolist(), strict=True)), bool, len(mine))
                found.append((d, x - starts[doc[keep]], c, (h[keep] % np.uint64(shards)).astype(np.int64), new))
                sent_reaches += [r for r, go in zip(mine, new.tolist(), strict=True) if go]
            batch = texts.column("slot")[0].as_py() // each
            d, x, c, shard, new = (np.concatenate(column) for column in zip(*found, strict=True))
            if not new.all():
                rows.append((batch % shards, batch, _pack_ids(d[~new]), zlib.compress(_bytes(x[~new]), 1), None, zlib.compress(_bytes((x + c + LENGTH - 1)[~new]), 1)))
            d, x, c, shard = d[new], x[new], c[new], shard[new]
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[low:high]
                strings = zstandard.compress(b"".join([sent_reaches[i] for i in at.tolist()]), 1)
                rows.append((int(shard[at[0]]), batch, _pack_ids(d[at]), zlib.compress(_bytes(x[at]), 1), zlib.compress(_bytes(c[at].astype(np.int32)), 1), strings))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    known = docs.where(F.col("doc_id").isNotNull()).repartition(parts, "slot")
    sent = known.groupBy("slot").cogroup(repeated.repartition(parts, "slot").groupBy("slot")).applyInArrow(gather, "shard int, batch int, docs binary, starts binary, counts binary, bytes binary")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels, held, known = None, Levels(), [], set()

        def spans_of(shard: int, batch: int) -> Iterator[pa.RecordBatch]:
            """Scans all that a shard has of a batch."""
            doc, start, count, flat = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            stops = np.cumsum(count + LENGTH - 1)
            raw, ends = flat.tobytes(), stops.tolist()
            mine = [raw[x:y] for x, y in zip([0, *ends], ends)]
            old = np.fromiter((r in known for r in mine), bool, len(mine))
            known.update(mine)
            if old.any():  # all strings of a reach that an earlier batch has had stand in a smaller document
                yield from spans_row(batch, doc[old], start[old], start[old] + count[old] + LENGTH - 1)
                flat = flat[np.repeat(~old, count + LENGTH - 1)]
                doc, start, count = doc[~old], start[~old], count[~old]
            place = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
            owner = np.repeat(np.arange(len(count)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            hit = levels.batch(doc[owner], flat, place[owner] + offset)
            # runs of matching strings of a reach
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            inner = np.flatnonzero(hit[1:] & hit[:-1] & (owner[1:] != owner[:-1])) + 1
            begin, stop = np.sort(np.concatenate([edge[::2], inner])), np.sort(np.concatenate([edge[1::2], inner]))
            o = owner[begin]
            yield from spans_row(batch, doc[o], start[o] + offset[begin], start[o] + offset[stop - 1] + LENGTH)

        def spans_row(batch: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
            slot = batch * each + np.mod(doc, each)
            for p in np.unique(slot).tolist():
                at = slot == p
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.array([_bytes(v[at])], pa.binary()) for v in (doc, start, end))], names=["slot", "docs", "starts", "ends"])

        for record in batches:
            for shard, batch, d, x, c, raw in zip(*(record.column(i) for i in range(6)), strict=True):
                key = shard.as_py(), batch.as_py()
                if key != now:
                    if held:
                        yield from spans_of(*now)
                    if now is None or now[0] != key[0]:
                        levels = Levels()
                        known.clear()
                    now = key
                doc, start = _unpack_ids(d.as_py()), np.frombuffer(zlib.decompress(x.as_py()), np.int64)
                if c.is_valid:
                    held.append((doc, start, np.frombuffer(zlib.decompress(c.as_py()), np.int32).astype(np.int64), np.frombuffer(zstandard.decompress(raw.as_py()), np.uint8)))
                else:
                    yield from spans_row(key[1], doc, start, np.frombuffer(zlib.decompress(raw.as_py()), np.int64))
        if held:
            yield from spans_of(*now)

    found = arrow_rows(sent.repartition(max(shards, parts), "shard").sortWithinPartitions("shard", "batch"), match, [("slot", T.LongType()), ("docs", T.BinaryType()), ("starts", T.BinaryType()), ("ends", T.BinaryType())])
    found = materialize(found, "dedup_spans")
    del sent, repeated
    return docs, found, parts


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, the removed spans (start and end byte) and the bytes that stay, of each document."""
    docs, found, parts = spans(docs, doc_id, text)

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if marks.num_rows:
            d, s, e = (np.frombuffer(b"".join(marks.column(c).to_pylist()), np.int64) for c in ("docs", "starts", "ends"))
            order = np.argsort(d, kind="stable")
            d, s, e = d[order], s[order], e[order]
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
            got = {int(d[x]): _merged(s[x:y], e[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        ids, sizes, removed, kept = texts.column("doc_id").to_pylist(), [], [], []
        for i, t in zip(ids, texts.column("text").to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            s, e = got.get(i, ((), ()))
            sizes.append(len(raw))
            removed.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
            edges = [0, *(int(v) for pair in zip(s, e, strict=True) for v in pair), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})

    return docs.repartition(parts, "slot").groupBy("slot").cogroup(found.repartition(parts, "slot").groupBy("slot")).applyInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
