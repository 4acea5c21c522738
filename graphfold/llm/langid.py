"""Language identification with bit-sliced Bloom filters over character trigrams.

Each slot of one table holds a mask with a bit for every language. A trigram's
languages are the AND of the masks in its slots, so one lookup answers for all
languages at once. A document's trigrams are counted per language, the counts
are corrected for each filter's rate of false positives, and the language with
the largest corrected count wins.

A trigram enters a language's filter if at least MIN_SHARE of the language's
documents hold it and the share is at least MIN_RATIO of its largest share in
any language. The shares come from all training documents. The table has SLOTS
slots whatever the size of the corpus, which bounds what is broadcast.

Edge cases: a null text, or one without letters, is `und` with score 0, as is
every text where nothing could be learned. Documents without a language are not
learned from. Ties go to the language that sorts first. A null doc_id counts as
the empty text. Rows that repeat an id are documents of their own. Texts of any
length are read whole. An empty table gives an empty result. Extra columns do not
matter. More than MOST_LANGS languages raise ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.llm.common import arrow_rows, materialize, slices, table, texts_of

SLOTS, HASHES = 1 << 19, 3
MIN_SHARE, MIN_RATIO = 0.01, 0.3
#: Languages that the filters may hold; it bounds the masks that are broadcast (SLOTS * MOST_LANGS / 8 bytes).
MOST_LANGS = 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the trigrams of lower-cased letters and word ends, the document of each, and which documents have letters."""
    docs = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(d) + 2 for d in docs], np.int64)
    flat = np.zeros(int(sizes.sum()), np.uint32)
    starts = np.cumsum(sizes) - sizes
    for d, s in zip(docs, starts.tolist(), strict=True):
        flat[s + 1 : s + 1 + len(d)] = d
    low = flat < 0x10000
    letter = _letters()[np.where(low, flat, 0)]
    if not low.all():
        at = np.flatnonzero(~low)
        letter[at] = [chr(c).isalpha() for c in flat[at].tolist()]
    flat = np.where(letter, flat, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    has = np.zeros(len(docs), bool)
    has[owner[letter]] = True
    # the middle is a letter; as texts are set apart by blanks, none spans two
    mid = np.flatnonzero(letter[1:-1]) + 1
    h = (flat[mid - 1] * _MIX[0]) ^ ((flat[mid] + np.uint64(1)) * _MIX[1]) ^ ((flat[mid + 1] + np.uint64(2)) * _MIX[2])
    h = (h ^ (h >> np.uint64(31))) * _MIX[3]
    return (h >> np.uint64(32)).astype(np.uint32), owner[mid], has


def slots(grams: np.ndarray, n_slots: int = SLOTS, hashes: int = HASHES) -> np.ndarray:
    """One column of slots for each hash, from two halves of a mixed hash."""
    h = grams.astype(np.uint64) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    a, b = h >> np.uint64(34), (h & np.uint64(0x3FFFFFFF)) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) % np.uint64(n_slots)).astype(np.int64) for i in range(hashes)], axis=1)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): in how many documents of a language a trigram occurs; gram null: how many documents it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([keys, *(p[0] for p in pending)]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([counts, *(p[1] for p in pending)]), len(k)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                grams, owner, _ = trigrams(texts_of(part))
                each = np.unique(owner.astype(np.uint64) << np.uint64(32) | grams)
                lang = np.array([names.setdefault(x, len(names)) for x in langs], np.uint64)
                for x in langs:
                    total[x] = total.get(x, 0) + 1
                pending.append(np.unique(lang[(each >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | (each & np.uint64(0xFFFFFFFF)), return_counts=True))
                if len(pending) >= 32:
                    keys, counts = merged()
                    pending.clear()
        if total:
            keys, counts = merged()
            order = list(names)
            for lo in range(0, len(keys), 1 << 16):
                k, c = keys[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([order[i] for i in (k >> np.uint64(32)).tolist()], pa.string()), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c)], names=["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([None] * len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    parts = arrow_rows(docs.select("text", F.col("lang").cast("string").alias("lang")), run, [("lang", T.StringType()), ("gram", T.LongType()), ("n", T.LongType())])
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The sliced filters of all languages: masks[slot, word] holds 64 languages a word."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        bits = [(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false = np.minimum(np.array(bits, np.float64) ** HASHES, 0.999)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Each text's language, its share of all languages' corrected counts, and the corrected share of the text's
        trigrams that its filter holds."""
        n, count = len(texts), len(self.langs)
        if not count:
            return ["und"] * n, [0.0] * n, [0.0] * n
        grams, owner, has = trigrams(texts)
        at = slots(grams, len(self.masks))
        found = self.masks[at[:, 0]]
        for j in range(1, at.shape[1]):
            found = found & self.masks[at[:, j]]
        total = np.bincount(owner, minlength=n)
        scores = np.empty((n, count))
        for i in range(count):
            hits = np.bincount(owner, (found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)), n)
            scores[:, i] = np.maximum(0, (hits - total * self.false[i]) / (1 - self.false[i]))
        best, whole = scores.argmax(axis=1), scores.sum(axis=1)
        top = scores[np.arange(n), best]
        names = [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has & (whole > 0), top / np.maximum(whole, 1e-12), 0.0).tolist(), (top / np.maximum(total, 1)).tolist()


def learn(docs: DataFrame, doc_id: str = "doc_id") -> Filters:
    """Filters from the documents with a language that are not held out. Only sums and a table of SLOTS masks reach the driver."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc % 3 != 1))
    counts = materialize(gram_counts(train), "langid_counts")
    totals = {r["lang"]: r["n"] for r in counts.where(F.col("gram").isNull()).select("lang", "n").limit(MOST_LANGS + 1).collect()}
    if len(totals) > MOST_LANGS:
        raise ValueError(f"the documents name more than {MOST_LANGS} languages")
    langs = sorted(totals)
    if not langs:
        return Filters([], np.zeros((SLOTS, 1), np.uint64))
    rows = [(x, i, totals[x]) for i, x in enumerate(langs)]
    index = spark.createDataFrame(rows, "lang string, bit int, docs long")  # a row for each language
    share = counts.where(F.col("gram").isNotNull()).join(F.broadcast(index), "lang").withColumn("share", F.col("n") / F.col("docs")).where(F.col("share") >= MIN_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    chosen = share.join(top, "gram").where(F.col("share") >= MIN_RATIO * F.col("top")).select("gram", "bit")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch.column("gram").to_numpy().astype(np.uint32))
            bit = np.repeat(batch.column("bit").to_numpy(), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array((bit // 64).astype(np.int32)), pa.array((np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64))], names=["slot", "word", "mask"])

    placed = arrow_rows(chosen, place, [("slot", T.LongType()), ("word", T.IntegerType()), ("mask", T.LongType())])
    masks = np.zeros((SLOTS, (len(langs) + 63) // 64), np.uint64)
    got = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[got.column("slot").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Filters(langs, masks)


def identify(docs: DataFrame, filters: Filters, text: str = "text", lang: str = "lang_pred", score: str = "score", covered: str = "covered") -> DataFrame:
    """docs with the predicted language, its share of all languages' corrected counts, and the share of the text's
    trigrams that its filter holds."""
    kept = [c for c in docs.columns if c not in (lang, score, covered)]
    docs = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                langs, scores, shares = shared.value.predict(texts_of(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*kept, lang, score, covered])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(covered, T.DoubleType())]))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), filters)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return out.select("doc_id", (crc % 3 == 1).alias("held_out"), "lang_pred", "score")


#: The stage rejects documents whose language's filter holds a smaller share of their trigrams. It does not depend on
#: how many languages are learned, or how much they have in common.
REJECT_BELOW = 0.3


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or few trigrams of any language. The documents' text and language
    teach the filters as in the query; where no language can be learned at all, nothing is judged and all stay."""
    filters = learn(docs)
    if not filters.langs:
        return docs
    out = identify(docs, filters, lang="__lang", score="__score", covered="__covered")
    return out.where((F.col("__lang") != "und") & (F.col("__covered") >= REJECT_BELOW)).select(*docs.columns)
