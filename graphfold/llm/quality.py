"""Quality classification by perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney model over runs of ORDER code points is
trained on documents that are labelled as good. Its tables are counts, contexts
and probabilities by n-gram, which grow with the trusted text and are never
gathered: every level comes from joins of sharded counts.

Documents are scored by another such join. Each task packs its documents into
batches and sends the distinct n-grams of a batch to the shards of the model; the
log-probabilities and back-off weights of those that the model holds come back
and meet the batch's texts, whose perplexities are then sums of look-ups. A batch
has far fewer distinct n-grams than characters.

One of HOLD trusted documents is held out of training. A document is kept if its
perplexity is at most SLACK times its language's quantile, which is taken from
held-out documents alone: the QUANTILE of its own n and that of all languages
together are averaged as logarithms, with weights n and PRIOR. The same formula
holds at every size.

Edge cases: a null or empty text has no perplexity and is not kept. No language,
and a language without held-out documents, take the quantile of all languages
together. Without any held-out document there is no threshold and every text with
characters is kept. Repeated labels count once, and a document with several
labels is trusted if any of them says so. Equal texts have equal perplexities, and
one that equals the threshold is kept. Texts of any length are scored whole; the character U+0000
is read as U+FFFD. Rows that repeat an id are rows of their own. Extra columns do
not matter, and empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphfold.llm.common import arrow_rows, attach, materialize, slices, table, texts_of
from graphfold.llm.shingles import mix

ORDER = 5
#: Bytes of text in a batch, and in a step of training.
BATCH_BYTES, TRAIN_BYTES = 32 << 20, 8 << 20
#: One of HOLD trusted documents is held out; a document is kept up to this quantile of its language, times the slack.
HOLD, QUANTILE, SLACK = 5, 0.98, 1.3
#: Held-out documents that all languages' quantile counts for beside a language's own.
PRIOR = 50
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: The n-gram that every batch asks for, so that a batch without an answer is noticed.
MARK = 1


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ORDER - 1 zeros before each, the places of the texts' own, and their numbers."""
    docs = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.zeros(int(sizes.sum()) + (ORDER - 1) * len(docs), np.uint32)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    for d, s in zip(docs, starts.tolist(), strict=True):
        flat[s : s + len(d)] = d
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(docs) + 1) * (ORDER - 1), sizes)
    flat[at[flat[at] == 0]] = 0xFFFD
    return flat, at, sizes


def hashes(flat: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to ORDER the hash of the n-gram that ends at each place."""
    total, wide = np.zeros(len(flat), np.uint64), flat.astype(np.uint64) + np.uint64(1)
    for n in range(ORDER):
        total[n:] += wide[: len(wide) - n] * _FACTORS[n]
        yield mix(total + np.array([n + 1], np.uint64) * _FACTORS[-1])


def hash_grams(grams: list[str], n: int) -> np.ndarray:
    """hashes() of n-grams that are strings of n code points."""
    m = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(m), np.uint64)
    for j in range(n):
        total += m[:, n - 1 - j] * _FACTORS[j]
    return mix(total + np.array([n], np.uint64) * _FACTORS[-1])


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each run of ORDER code points occurs in all texts; gaps before a text are U+0000."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TRAIN_BYTES):
                flat, at, _ = points(texts_of(part))
                if not len(at):
                    continue
                *_, h = hashes(flat)
                _, first, n = np.unique(h[at], return_index=True, return_counts=True)
                rows = np.ascontiguousarray(flat[at[first][:, None] + np.arange(1 - ORDER, 1)])
                grams = rows.view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return arrow_rows(docs.select("text"), run, [("gram", T.StringType()), ("n", T.LongType())]).groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order, from how many n-grams have each of the counts 1 to 4."""
    row = counts.agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()[0]
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for i, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(i - (i + 1) * y * high / low, 0.05), i - 0.05) if low else 0.5 * i)
    return tuple(out)


class Model:
    """A table (gram, logp, back) by hash of n-gram: its log-probability, null where it is a context only, and the log
    of its back-off weight as a context, null where nothing followed it. `unseen` holds for characters it has not met."""

    def __init__(self, grams: DataFrame, unseen: float):
        self.grams, self.unseen = grams, unseen


def train(docs: DataFrame) -> Model:
    """Trains on the texts of docs."""
    levels = {ORDER: materialize(count_grams(docs), "quality_counts")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams one is the tail
        levels[n] = materialize(levels[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), f"quality_{n}")
    unseen, lower, parts = 0.0, None, []
    for n, level in sorted(levels.items()):
        d1, d2, d3 = _discounts(level)
        level = level.withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        if n == 1:
            total, mass, letters = level.agg(F.sum("n"), F.sum("d"), F.count("*")).collect()[0]
            flat = mass / total / (letters + 1) if total else 1.0
            unseen = math.log(flat)
            prob = level.select("gram", ((F.col("n") - F.col("d")) / F.lit(total or 1) + flat).alias("p"))
        else:
            level = level.withColumns({"context": F.substring("gram", 1, n - 1), "tail": F.substring("gram", 2, n - 1)})
            contexts = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
            parts.append((n - 1, contexts.select(F.col("context").alias("gram"), F.lit(None).cast("float").alias("logp"), F.log(F.col("mass") / F.col("total")).cast("float").alias("back"))))
            below = lower.select(F.col("gram").alias("tail"), F.col("p").alias("low"))
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("mass") / F.col("total") * F.col("low")
            prob = level.join(contexts.hint("merge"), "context").join(below.hint("merge"), "tail").select("gram", p.alias("p"))
        lower = materialize(prob, f"quality_p{n}")
        parts.append((n, lower.select("gram", F.log("p").cast("float").alias("logp"), F.lit(None).cast("float").alias("back"))))

    def hashed(n: int, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(hash_grams(batch.column("gram").to_pylist(), n).view(np.int64)), *batch.columns[1:]], names=["gram", "logp", "back"])

        return arrow_rows(rows, run, [("gram", T.LongType()), ("logp", T.FloatType()), ("back", T.FloatType())])

    every = hashed(*parts[0])
    for n, rows in parts[1:]:
        every = every.unionByName(hashed(n, rows))
    model = every.groupBy("gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back"))
    return Model(materialize(model, "quality_model"), unseen)


class Found:
    """What the model holds of a batch's n-grams, for look-ups by hash."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, back: np.ndarray, unseen: float):
        order = np.argsort(grams, kind="stable")
        self.keys = np.append(grams[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.logp, self.back, self.unseen = np.append(logp[order], np.nan), np.nan_to_num(np.append(back[order], 0.0)), unseen
        bits = min(22, max(8, len(grams).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        # where the hashes with each first bits begin, from how many have them: one small array, no search for each slot
        self.first = np.zeros(1 << bits, np.int32)
        at, n = np.unique((self.keys[:-1] >> self.shift).astype(np.int32), return_counts=True)
        self.first[at[at < (1 << bits) - 1] + 1] = n[at < (1 << bits) - 1]
        np.cumsum(self.first, out=self.first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or that of the end."""
        at = self.first[(h >> self.shift).astype(np.int32)]
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        at[self.keys[at] != h] = len(self.keys) - 1
        return at

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of log-probabilities of each text, and its number of code points."""
        flat, left, sizes = points(texts)
        h = list(hashes(flat))
        out = np.zeros(len(flat))
        for n in range(ORDER, 0, -1):
            got = self.logp[self.find(h[n - 1][left])]
            hit = ~np.isnan(got)
            out[left[hit]] += got[hit]
            left = left[~hit]
            out[left] += self.back[self.find(h[n - 2][left - 1])] if n > 1 else self.unseen
        ends = np.concatenate([[0.0], np.cumsum(out)])
        stops = np.cumsum(sizes + ORDER - 1)
        return ends[stops] - ends[stops - sizes], sizes


def _packed(docs: DataFrame) -> DataFrame:
    """(batch, blob): the rows of docs, packed where they lie. A batch is named by its content, so that it has the same
    name in both of its scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are compressed as they come, so that a batch is never held as it is
        z, sink, writer, size = zstandard.ZstdCompressor(1), None, None, 0

        def flush() -> pa.RecordBatch:
            writer[1].close()
            writer[0].flush(zstandard.FLUSH_FRAME)
            blob = sink.getvalue()
            name = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                if writer is None:
                    sink = io.BytesIO()
                    stream = z.stream_writer(sink, closefd=False)
                    writer = stream, pa.ipc.new_stream(stream, part.schema)
                writer[1].write_batch(part)
                size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else part.nbytes
                if size >= BATCH_BYTES:
                    yield flush()
                    sink, writer, size = None, None, 0
        if writer is not None:
            yield flush()

    return arrow_rows(docs, run, [("batch", T.LongType()), ("blob", T.BinaryType())])


def _unpacked(blob: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, of which a part at a time is held."""
    with zstandard.ZstdDecompressor().stream_reader(blob) as rows:
        yield from pa.ipc.open_stream(rows)


def _asked(packed: DataFrame) -> DataFrame:
    """(gram, batch): the distinct n-grams of each batch. A table of what was seen last in each slot leaves few to sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for name, blob in zip(record.column("batch").to_pylist(), record.column("blob").to_pylist(), strict=True):
                seen, out = np.zeros(1 << 20, np.uint64), [np.array([MARK], np.uint64)]
                for part in _unpacked(blob):
                    flat, at, _ = points(texts_of(part))
                    place = np.zeros(len(flat), bool)
                    place[at] = place[at - 1] = True  # contexts begin in the gap before a text
                    for n, h in enumerate(hashes(flat), 1):
                        h = h[place] if n < ORDER else h[at]
                        new = np.unique(h[seen[(h >> np.uint64(44)).astype(np.int64)] != h])
                        seen[(new >> np.uint64(44)).astype(np.int64)] = new
                        out.append(new)
                grams = np.unique(np.concatenate(out)).view(np.int64)
                for lo in range(0, len(grams), 1 << 16):
                    g = pa.array(grams[lo : lo + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([g, pa.array(np.full(len(g), name, np.int64))], names=["gram", "batch"])

    return arrow_rows(packed, run, [("gram", T.LongType()), ("batch", T.LongType())])


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "perplexity") -> DataFrame:
    """The columns of docs but the text, with each text's perplexity per code point, null for a text without any, and
    their number, n_scored."""
    kept = [c for c in docs.columns if c not in (output, "n_scored", text)]
    docs = docs.select(*kept, F.col(text).cast("string").alias("text"))
    unseen = model.unseen
    # as many shares as full batches, so that a share does not grow with the input, and no fewer than a shuffle has
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    packed, shares = _packed(docs), max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BATCH_BYTES))
    none = F.lit(None).cast("float")
    mark = docs.sparkSession.range(MARK, MARK + 1, numPartitions=1).select(F.col("id").alias("gram"), none.alias("logp"), none.alias("back"))
    answers = materialize(_asked(packed).join(model.grams.unionByName(mark).hint("merge"), "gram"), "quality_answers")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "text"), T.StructField(output, T.DoubleType()), T.StructField("n_scored", T.LongType())])
    empty = to_arrow_schema(schema).empty_table()

    def run(blobs: pa.Table, grams: pa.Table) -> pa.Table:
        rows = []
        if blobs.num_rows and not grams.num_rows:
            raise RuntimeError("a batch of documents was not the same in two scans")
        if blobs.num_rows:
            one = lambda c: grams.column(c).to_numpy()
            found = Found(one("gram").view(np.uint64), one("logp").astype(np.float64), one("back").astype(np.float64), unseen)
            for blob in blobs.column("blob").to_pylist():
                for part in _unpacked(blob):
                    sums, sizes = found.score(texts_of(part))
                    got = [round(math.exp(-s / n), 6) if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
                    rows.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(got, pa.float64()), pa.array(sizes, pa.int64())], names=[*kept, output, "n_scored"]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(rows) if rows else empty

    return packed.repartition(shares, "batch").groupBy("batch").cogroup(answers.repartition(shares, "batch").groupBy("batch")).applyInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold and keep for each document."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD)) == 0
    # labels grow with the corpus: a merge join at every size, rather than a broadcast while they are few
    model = train(docs.where(F.col("text").isNotNull()).join(good.where(~held).hint("merge"), "doc_id", "left_semi").select("text"))
    scored = materialize(score(docs, model), "quality_scored")
    trusted = scored.where(F.col("perplexity").isNotNull()).join(good.hint("merge"), "doc_id", "left_semi").withColumn("held", held)
    quantile = F.percentile_approx("perplexity", QUANTILE, 10_000)
    whole = trusted.where("held").agg(quantile).collect()[0][0]
    whole = F.lit(None if whole is None else float(whole)).cast("double")
    n = F.col("held_out")
    own = trusted.where("held").groupBy("lang").agg(quantile.alias("own"), F.count("*").alias("held_out")).where(F.col("lang").isNotNull())
    own = materialize(own.select("lang", F.exp((n * F.log("own") + PRIOR * F.log(whole)) / (n + PRIOR)).alias("own"), "held_out"), "quality_limits")
    limit = F.coalesce(F.col("own"), whole) * SLACK
    rows = attach(scored, own, ["lang"], "held_out", ["doc_id", "n_scored"])
    return rows.select(
        "doc_id", "lang", "n_scored", "perplexity", limit.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("keep")
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
