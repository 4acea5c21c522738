"""Embedding and language-model providers behind small protocols, with stubs for tests, batching and retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphfold.config import EngineConfig
from graphfold.errors import EmbeddingDimension, Upstream
from graphfold.plans.ship import ship

R = TypeVar("R")


class EmbeddingClient(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class LanguageClient(Protocol):
    def complete(self, system: str, user: str, temperature: float = 0.0) -> str: ...


class HashEmbeddings:
    """Deterministic unit vectors from a text's words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in (t or "").lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class EchoLanguage:
    """Answers with a fixed function of the request."""

    def __init__(self, reply: Callable[[str, str], str] | None = None):
        self.reply = reply or (lambda system, user: f"answer:{len(user)}")

    def complete(self, system: str, user: str, temperature: float = 0.0) -> str:
        return self.reply(system, user)


def transient(error: Exception) -> bool:
    """Time-outs, lost connections, too many requests and server errors are worth another try."""
    status = getattr(error, "status_code", None)
    return isinstance(error, (TimeoutError, ConnectionError)) or isinstance(status, int) and (status == 429 or status >= 500)


def with_retries(call: Callable[[], R], retries: int = 2, base: float = 0.25, cap: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> R:
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if not transient(e) or attempt == retries:
                raise Upstream(str(e)) from e
            sleep(min(cap, base * 2**attempt))
    raise AssertionError


def fit(vector: Sequence[float], dim: int) -> list[float]:
    """As functions.vectors.fit_embedding, for values on the driver or in a worker."""
    if len(vector) < dim:
        raise EmbeddingDimension(f"embedding needs {dim} components, got {len(vector)}")
    if len(vector) == dim:
        return list(vector)
    head = np.asarray(vector[:dim], float)
    n = float(np.sqrt((head * head).sum()))
    return (head / n if n else head).tolist()


def embed_texts(client: EmbeddingClient, texts: Sequence[str], config: EngineConfig) -> list[list[float]]:
    """Vectors of texts in batches, each fitted to the dimension."""
    out: list[list[float]] = []
    for i in range(0, len(texts), config.embedding_batch_size):
        part = list(texts[i : i + config.embedding_batch_size])
        got = with_retries(lambda part=part: client.embed(part), config.max_retries, config.retry_base, config.retry_cap)
        if len(got) != len(part):
            raise Upstream(f"asked for {len(part)} embeddings, got {len(got)}")
        out += [fit(v, config.dim) for v in got]
    return out


def with_embeddings(df: DataFrame, client: EmbeddingClient, config: EngineConfig, text: str = "text", output: str = "embedding", strict: bool = True) -> DataFrame:
    """df with the embedding of a text column. Workers call the provider, Arrow batch by Arrow batch. Without strict, a text
    that cannot be embedded has an error in `{output}_error` instead: where a batch fails, its texts are tried one by one."""
    ship(df.sparkSession)
    df = df.drop(output, f"{output}_error")
    errors = [] if strict else [T.StructField(f"{output}_error", T.StringType())]
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType())), *errors])

    def one(value: str) -> tuple[list[float] | None, str | None]:
        try:
            return embed_texts(client, [value], config)[0], None
        except (Upstream, EmbeddingDimension) as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[text].fillna("").tolist()
            if strict:
                yield pdf.assign(**{output: embed_texts(client, texts, config)})
                continue
            got: list[tuple[list[float] | None, str | None]] = []
            for i in range(0, len(texts), config.embedding_batch_size):
                part = texts[i : i + config.embedding_batch_size]
                try:
                    got += [(v, None) for v in embed_texts(client, part, config)]
                except (Upstream, EmbeddingDimension):
                    got += [one(t) for t in part]
            yield pdf.assign(**{output: [v for v, _ in got], f"{output}_error": [e for _, e in got]})

    return df.mapInPandas(run, schema)


def with_completions(df: DataFrame, client: LanguageClient, config: EngineConfig, system: str, user: str = "prompt", output: str = "reply", temperature: float = 0.0, concurrency: int | None = None) -> DataFrame:
    """df with a model's reply to each row and, where it failed, the error; each task has at most `concurrency` requests
    under way. Rows stay in their partitions, so requests grow with the tasks that the cluster runs."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType()), T.StructField(f"{output}_error", T.StringType())])

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return with_retries(lambda: client.complete(system, prompt, temperature), config.max_retries, config.retry_base, config.retry_cap) or "", None
        except Upstream as e:
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency or 1) as pool:
            for pdf in frames:
                got = list(pool.map(ask, pdf[user].tolist()))
                yield pdf.assign(**{output: [r for r, _ in got], f"{output}_error": [e for _, e in got]})

    return df.mapInPandas(run, schema)
