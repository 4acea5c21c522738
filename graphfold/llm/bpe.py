"""BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part ids beside a list of the ranks of adjacent
parts. The smallest rank is searched again and again, the boundary under it is
deleted, and the two neighbouring ranks are refreshed. Words of more than
LONG_WORD parts go through a heap over a linked list instead, with the same
result, so that a text without spaces does not cost quadratic time. The words
that a slice of texts needs and the cache lacks are merged together, one row of
the arrays for each word.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to
an empty text; rows keep their order and number, and repeated rows repeat.
Extra columns of the input are kept; one with the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphfold.llm.common import slices, texts_of

LONG_WORD = 48
#: Words kept in a worker's cache; it is emptied when it is full.
CACHE_WORDS = 250_000
NONE = 1 << 30
#: Row widths of the arrays in which words are merged together.
WIDTHS = (4, 8, 12, 16, 24, 32, LONG_WORD)

#: The characters that the vocabulary's normaliser takes as white space.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Characters at which str.split() cuts although they are not white space above.
NOT_WHITE = regex.compile("[\x1c-\x1f]")

#: Capitals that the vocabulary's normaliser knows and older Unicode tables do not, with their small letters.
SMALL_LETTERS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL_LETTERS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
YOUNG_CAPITALS = re.compile("[" + "".join(map(chr, SMALL_LETTERS)) + "]").search

#: Letters and digits of the blocks up to U+024F, for which the standard library's faster patterns do.
LETTERS, DIGITS = ("".join(c for c in map(chr, range(0x250)) if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
LATIN_WORD, LATIN = re.compile(f"[{LETTERS}]+").fullmatch, re.compile("[\0-\u024f]+").fullmatch


#: The letters that Unicode 16 added, first and last of each range. The vocabulary's pattern knows them, and
#: none that are younger.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)


@lru_cache(maxsize=1)
def _young() -> str:
    """A class of the letters that the pattern engine knows and the vocabulary's pattern does not: those that the standard
    library's tables (Unicode 15.1) lack and that Unicode 16 has not added."""
    known = {c for a, b in LETTERS_16 for c in range(a, b + 1)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = [ord(c) for c in regex.findall(r"\p{L}", every) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    if not found:
        return "[^\\s\\S]"
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends, strict=True)) + "]"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE whose words end with a suffix, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for x in spec["added_tokens"]:
            self.tokens[x["id"]] = x["content"]
            self.special[x["content"]] = x["id"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[(a[: -len(end)] if end and a.endswith(end) else a) + b])
        pairs = sorted((a << 20 | b, rank) for (a, b), rank in self.ranks.items())
        self.pair_keys = np.array([k for k, _ in pairs] or [0], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [NONE], np.int32)
        self.merged_ids = np.array([*self.merged, 0], np.int32)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        # \s of the file's pattern is spelled out, as engines differ on four control characters
        # and letters that are younger than the library's tables are no letters to it
        pattern_ = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^{WHITE}\p{{L}}\p{{N}}]|{_young()})")
        for kind in (r"[\p{L}]", r"[\p{N}]"):
            pattern_ = pattern_.replace(kind, f"(?:(?!{_young()}){kind})")
        self.words = regex.compile(pattern_).findall
        self.latin_words = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{LETTERS}{DIGITS}]").replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{DIGITS}]")).findall
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, bytes] = _Words(self.word)
        self.chunk_cache: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """White space is left as it is: no word has any, so its collapse changes nothing."""
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text if text.isascii() or not YOUNG_CAPITALS(text) else text.translate(SMALL_LETTERS)

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return np.array(self._merge_long(parts) if len(parts) > LONG_WORD else self._merge(parts), "<u4").tobytes()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs a, b; NONE for a pair that never merges and beside a hole (-1)."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """parts: a row of part ids for each word, filled up with -1. Merges all rows in place and returns them."""
        done = np.arange(len(parts))
        out, now = parts, parts.copy()
        ranks = self._rank(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(len(now), -1)
        columns = np.arange(now.shape[1])
        while len(now):
            i = ranks.argmin(axis=1)
            rows = np.arange(len(now))
            low = ranks[rows, i]
            if (stop := low == NONE).any():
                out[done[stop]] = now[stop]
                go = ~stop
                now, ranks, done, i, low = now[go], ranks[go], done[go], i[go], low[go]
                if not len(now):
                    break
                rows = rows[: len(now)]
            # the boundary after part i goes: what lies behind it moves up by one
            moved = np.full_like(now, -1)
            moved[:, :-1] = now[:, 1:]
            now = np.where(columns > i[:, None], moved, now)
            now[rows, i] = self.merged_ids[low]
            moved = np.full_like(ranks, NONE)
            moved[:, :-1] = ranks[:, 1:]
            ranks = np.where(columns[:-1] >= i[:, None], moved, ranks)
            left = np.maximum(i - 1, 0)
            ranks[rows, left] = np.where(i > 0, self._rank(now[rows, left], now[rows, i]), ranks[rows, left])
            right = np.minimum(i + 1, now.shape[1] - 1)
            has = i < ranks.shape[1]
            at = np.minimum(i, ranks.shape[1] - 1)
            ranks[rows, at] = np.where(has, self._rank(now[rows, i], now[rows, right]), ranks[rows, at])
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of words into the cache, as little-endian bytes. Words of one width are merged together."""
        words = list(words)
        if not words:
            return
        raws = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for k, width in enumerate(WIDTHS):
            if not len(at := np.flatnonzero((sizes <= width) & (sizes > (WIDTHS[k - 1] if k else 0)))):
                continue
            n, at = sizes[at], at.tolist()
            flat = np.frombuffer(b"".join([raws[i] for i in at]), np.uint8)
            parts = np.full((len(at), width), -1, np.int32)
            parts[np.arange(width) < n[:, None]] = self.inner_ids[flat]
            parts[np.arange(len(at)), n - 1] = self.last_ids[flat[np.cumsum(n) - 1]]
            parts = self.merge_rows(parts)
            blob, stops = parts[parts >= 0].astype("<u4").tobytes(), (4 * np.cumsum((parts >= 0).sum(axis=1))).tolist()
            self.cache.update(zip([words[i] for i in at], [blob[a:b] for a, b in zip([0, *stops], stops)], strict=True))

    def chunks(self, text: str) -> list[str]:
        """Normalised runs without white space. No word spans two of them."""
        text = self.normal(text)
        return [x for x in regex.split(f"[{WHITE}]+", text) if x] if NOT_WHITE.search(text) else text.split()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """encode() of each text; chunks that are new to the cache are taken apart, and their words merged together."""
        if max(len(self.cache), len(self.chunk_cache)) > CACHE_WORDS:
            self.cache.clear()
            self.chunk_cache.clear()
        split = [[(k % 2, piece if k % 2 else self.chunks(piece)) for k, piece in enumerate(self.marks.split(t) if self.marks and "<" in t else (t,)) if piece] for t in texts]
        new = set().union(*(chunks for pieces in split for mark, chunks in pieces if not mark)) - self.chunk_cache.keys()
        words = {x: [x] if LATIN_WORD(x) else self.latin_words(x) if LATIN(x) else self.words(x) for x in new}
        self.learn({w for ws in words.values() for w in ws} - self.cache.keys())
        get = self.cache.__getitem__
        long = {}
        for x, ws in words.items():
            (self.chunk_cache if len(x) <= 2 * LONG_WORD else long)[x] = b"".join(map(get, ws))
        out = []
        for pieces in split:
            raw = []
            for mark, chunks in pieces:
                if mark:
                    raw.append(self.special[chunks].to_bytes(4, "little"))
                elif long:
                    raw.extend(long[x] if x in long else self.chunk_cache[x] for x in chunks)
                else:
                    raw.extend(map(self.chunk_cache.__getitem__, chunks))
            out.append(np.frombuffer(b"".join(raw), "<u4"))
        return out

    def _merge(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = [get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [x for x in parts if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces, as the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if len(word) <= LONG_WORD:
            self[word] = found
        return found


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What encode() can add, with Spark's and Arrow's types.
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "token_ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode(docs: DataFrame, text: str = "text", path: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """docs with the ids of each text: their number, the ids, the text decoded from them, or digests of both."""
    path, outputs = path or vocabulary(), tuple(outputs)
    kept = [c for c in docs.columns if c not in outputs]
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, OUTPUTS[x][0]) for x in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                got: dict[str, list] = {x: [] for x in outputs}
                for ids in bpe.encode_batch(texts_of(part, text)):
                    back = bpe.decode(ids) if "decoded" in got or "decoded_sha256" in got else ""
                    for x, out in got.items():
                        if x == "n_tokens":
                            out.append(len(ids))
                        elif x == "token_ids":
                            out.append(ids.astype(np.int32))
                        elif x == "decoded":
                            out.append(back)
                        else:
                            out.append(hashlib.sha256(ids.tobytes() if x == "ids_sha256" else back.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[x], OUTPUTS[x][1]) for x in outputs)], names=[*kept, *outputs])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "token_ids", path: str | None = None, output: str = "decoded") -> DataFrame:
    """encoded with the text of an array of ids; null ids give an empty text."""
    path = path or vocabulary()
    encoded = encoded.select(*(c for c in encoded.columns if c != output))
    schema = T.StructType([*encoded.schema.fields, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in batches:
            back = pa.array([bpe.decode(x or ()) for x in part.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*part.schema.names, output])

    return encoded.mapInArrow(run, schema)


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    from graphfold.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with a digest of the text decoded from them."""
    return encode(docs, outputs=("n_tokens", "token_ids", "decoded_sha256")).select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256")
