import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphfold.llm import bpe, flac

MINE, LIBRARY = bpe.load(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())


def test_bpe_agrees_on_every_code_point():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{}b", "1{} "):
        for i in range(0, len(every), 50_000):
            texts = [form.format(chr(c)) for c in every[i : i + 50_000]]
            want = [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
            assert [x.tolist() for x in MINE.encode_batch(texts)] == want


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = MINE.encode(text).tolist()
    assert got == want
    assert MINE.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "It's THE 42nd test!!", "<|endoftext|>a<|startoftext|> b", "ΣΑΣ ΣΣ", "a\x1cb\x85c d", "é é", "x" * 300 + "th" * 200, "日本語 \U0001f642", "1²½", "don't we've", "<|endoftext"])
def test_bpe_agrees_with_the_library(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_agrees_on_latin_text(text):
    same(text)


def test_long_and_short_words_merge_alike():
    rng = random.Random(1)
    for n in (2, 5, 17, 48):
        word = "".join(rng.choice("eationrsth") for _ in range(n))
        parts = [MINE.inner[b] for b in word.encode()]
        parts[-1] = MINE.last[word.encode()[-1]]
        rows = np.full((1, n), -1, np.int32)
        rows[0] = parts
        assert MINE._merge(list(parts)) == MINE._merge_long(list(parts)) == [x for x in MINE.merge_rows(rows)[0].tolist() if x >= 0]


def test_bpe_frame(odd_docs, no_docs, texts):
    got = bpe.encode(odd_docs, outputs=("n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    for r, (_, t) in zip(got, texts, strict=True):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    back = bpe.decode(bpe.encode(odd_docs)).select("decoded", "token_ids").collect()
    assert [r["decoded"] for r in back] == [r["decoded"] for r in got]
    assert bpe.encode(no_docs).count() == 0


def crc16_slowly(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = ((c << 1) ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
    return c


def test_checksums():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 63, 4096, 4097, 4098, 9001):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        assert flac.crc16(data) == crc16_slowly(data.tobytes())
    assert flac.crc8(b"123456789") == 0xF4
    assert all(flac._coded_number(n) == chr(n).encode() for n in (0, 127, 128, 2047, 2048, 65535, 65536))


def signals():
    rng = np.random.default_rng(1)
    yield bytes(64)
    yield bytes(range(256)) * 40
    yield rng.integers(0, 256, 8192, dtype=np.uint8).tobytes()
    yield (np.sin(np.arange(19_200) / 9) * 100 + 128).astype(np.uint8).tobytes()
    yield np.cumsum(rng.integers(-1, 2, 64_000)).astype(np.uint8).tobytes()
    yield flac.padded("Ein Text, der länger ist. ".encode() * 300)


@pytest.mark.parametrize("order", [0, 1, 4, 8])
def test_flac_round_trip(order):
    for payload in signals():
        stream = flac.encode(payload, order)
        assert flac.pcm(stream) == payload
        for at in {0, len(payload) // 2, len(payload) - 1}:
            start, block = flac.seek(stream, at)
            assert (block + 128).astype(np.uint8).tobytes() == payload[start : start + len(block)] and start <= at < start + len(block)


def test_flac_notices_damage():
    stream = flac.encode(next(p for p in signals() if len(p) > 10_000))
    want, rng = flac.pcm(stream), random.Random(5)
    for cut in sorted({*range(0, 60), *(rng.randrange(len(stream)) for _ in range(60))}):
        with pytest.raises(ValueError):
            flac.pcm(stream[:cut])
    first = 4 + 4 + 34  # what the header says of frame sizes and rate may differ; what is decoded may not
    for _ in range(150):
        damaged, bit = bytearray(stream), rng.randrange(8 * first, 8 * len(stream))
        damaged[bit // 8] ^= 1 << bit % 8
        try:
            assert flac.pcm(bytes(damaged)) == want and bit < 8 * (len(stream) - 4096)
        except ValueError:
            pass
    with pytest.raises(ValueError):
        flac.pcm(b"RIFF")


def test_flac_seeks_by_its_table():
    payload = bytes((i * i >> 7) & 255 for i in range(50_000))
    stream = flac.Stream(flac.encode(payload))
    frames = stream.starts
    broken = bytearray(stream.stream)
    broken[frames[0] + 8] ^= 255  # the first frame cannot be read, the others can
    start, block = flac.seek(bytes(broken), 30_000)
    assert start == 28_672 and (block + 128).astype(np.uint8).tobytes() == payload[start : start + 4096]
    with pytest.raises(ValueError):
        flac.seek(bytes(broken), 5)
    with pytest.raises(ValueError):
        flac.seek(stream.stream, 50_000)


def test_flac_uses_partitions_and_predictors():
    quiet_then_loud = np.concatenate([np.zeros(2048), np.random.default_rng(3).normal(0, 40, 2048)]).clip(-100, 100) + 128
    smooth = 90 * np.sin(np.arange(4096) / 5) + 20 * np.sin(np.arange(4096) / 2.3) + 128
    kinds = []
    for x in (quiet_then_loud, smooth):
        payload = x.astype(np.uint8).tobytes()
        stream = flac.encode(payload)
        assert flac.pcm(stream) == payload
        kinds.append(flac.Stream(stream).frames()[0])
        kinds.append(len(stream))
    assert kinds[2].shift and len(kinds[2].how) == flac.LPC_ORDER
    u = np.abs(quiet_then_loud.astype(np.int64) - 128)
    assert len(flac._rice_plan(u, 0)[1]) > 1


def test_flac_works_on_many_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    payloads = [*signals(), b"", *(bytes(rng.integers(97, 97 + 2 + n % 25, n, dtype=np.uint8)) for n in (1, 7, 9, 18, 64, 130, 4100, 9000))]
    for order in (0, 3, 8):
        streams = flac.encode_many(payloads, order)
        assert streams == [flac.encode(p, order) for p in payloads]
        assert [flac._joined(f) for f in flac.decode(streams)] == payloads
    # Rice codes of frames that a seek table names are read together; a frame by itself is the exception
    words = [flac.padded(" ".join(rng.choice(["ein", "Text", "aus", "Worten", "und"], 900)).encode()) for _ in range(30)]
    streams, calls = flac.encode_many(words), []
    by_itself = flac.Stream.frame
    monkeypatch.setattr(flac.Stream, "frame", lambda s, at, start: calls.append(at) or by_itself(s, at, start))
    assert [flac._joined(f) for f in flac.decode(streams)] == words and not calls
    broken = bytearray(streams[3])
    broken[-1] ^= 1
    assert flac.blocks(streams[2]) and not calls
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode([streams[2], bytes(broken)])
    assert len(calls) == 1


def test_flac_plans_of_many_blocks_are_those_of_each():
    rng, sizes, orders = np.random.default_rng(4), np.array([4096, 64, 10, 32, 130, 4096]), np.array([0, 3, 2, 8, 1, 8])
    starts = np.cumsum(sizes) - sizes
    u = np.concatenate([rng.geometric(p, n).astype(np.int32) - 1 for p, n in zip((0.5, 0.1, 0.02, 0.3, 0.01, 0.9), sizes)])
    u[2048:4096] *= 40
    for s, o in zip(starts, orders):
        u[s : s + o] = 0
    cost, parts, ks = flac._rice_plans(u, starts, sizes, orders)
    for b, (s, n, o) in enumerate(zip(starts, sizes, orders)):
        want, its, k = flac._rice_plan(u[s + o : s + n].astype(np.int64), int(o))
        assert (cost[b], parts[b], ks[b, : parts[b]].tolist()) == (want, len(its), k)


def test_query_reads_what_was_stored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in flac.op4_flac_media(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        raw = (r["text"] or "").encode()
        payload = flac.padded(raw)
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = flac.encode(payload)
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_flac_frame(odd_docs, no_docs, texts):
    media = flac.to_flac(odd_docs)
    got = media.select("text", "media").collect()
    assert [flac.pcm(r["media"]) for r in got] == [flac.padded((t or "").encode()) for _, t in texts]
    assert got[2]["media"] == got[3]["media"]
    blocks = flac.pcm_blocks(media.where("doc_id = 8"), "doc_id").orderBy("first_sample").collect()
    assert [b["first_sample"] for b in blocks] == list(range(0, 20_032, 4096)) and b"".join(b["pcm"] for b in blocks) == flac.padded(b"x" * 20_000)
    assert flac.to_flac(no_docs).count() == 0
    back = flac.read_back(media.withColumn("feature", F.lit("clash")))
    assert back.columns == [c for c in media.columns if c != "media"] + [n for n, _, _ in flac.READ] and back.count() == len(texts)
    nulls = flac.read_back(media.withColumn("media", F.lit(None).cast("binary"))).collect()
    assert all(r["payload_sha256"] is None for r in nulls) and flac.pcm_blocks(media.withColumn("media", F.lit(None).cast("binary")), "doc_id").count() == 0
    assert flac.read_back(flac.to_flac(no_docs)).count() == 0
