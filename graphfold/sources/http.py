"""Clients of providers that speak the usual JSON over HTTP: embeddings and chat completions."""

from __future__ import annotations

import http.client
import json
import threading
import time
from collections.abc import Sequence
from urllib.parse import urlsplit

from graphfold.errors import Upstream


class Refused(Exception):
    """A reply with an error's status; some are worth another try."""

    def __init__(self, status_code: int, said: str):
        super().__init__(f"status {status_code}: {said}")
        self.status_code = status_code


class HttpClient:
    """One provider at a base address. Each thread keeps a connection open, and a process sends at most per_second requests.
    Workers get a copy without connections."""

    def __init__(self, base: str, model: str, key: str | None = None, timeout: float = 60.0, per_second: float | None = None):
        self.base, self.model, self.key, self.timeout, self.per_second = base.rstrip("/"), model, key, timeout, per_second
        self._open()

    def _open(self) -> None:
        self._held, self._lock, self._next = threading.local(), threading.Lock(), 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_held", "_lock", "_next")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _wait(self) -> None:
        if not self.per_second:
            return
        with self._lock:
            now = time.monotonic()
            at = max(now, self._next)
            self._next = at + 1 / self.per_second
        time.sleep(at - now)

    def post(self, path: str, body: dict) -> dict:
        """The reply to a request. Lost connections and time-outs raise ConnectionError and TimeoutError, an error's status Refused."""
        self._wait()
        to = urlsplit(self.base)
        if getattr(self._held, "connection", None) is None:
            kind = http.client.HTTPSConnection if to.scheme == "https" else http.client.HTTPConnection
            self._held.connection = kind(to.netloc, timeout=self.timeout)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            self._held.connection.request("POST", to.path + path, json.dumps(body), headers)
            reply = self._held.connection.getresponse()
            said = reply.read()
        except (http.client.HTTPException, OSError) as e:
            self._held.connection.close()
            self._held.connection = None
            if isinstance(e, TimeoutError):
                raise
            raise ConnectionError(str(e)) from e
        if reply.status >= 400:
            raise Refused(reply.status, said[:1000].decode("utf-8", "replace"))
        try:
            return json.loads(said)
        except ValueError as e:
            raise Upstream("the reply is not JSON") from e


class HttpEmbeddings(HttpClient):
    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """Vectors in the order of texts, whatever the order of the reply."""
        if not texts:
            return []
        items = self.post("/embeddings", {"model": self.model, "input": list(texts)}).get("data") or []
        by_index = {item.get("index"): item.get("embedding") for item in items}
        vectors = [by_index.get(i) for i in range(len(texts))]
        if None in vectors or len(items) != len(texts):
            raise Upstream(f"asked for {len(texts)} embeddings, got {sum(v is not None for v in vectors)} of {len(items)}")
        return vectors


class HttpLanguage(HttpClient):
    def complete(self, system: str, user: str, temperature: float = 0.2) -> str:
        """The first choice's text; empty if the model gave none."""
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        choices = self.post("/chat/completions", {"model": self.model, "temperature": temperature, "messages": messages}).get("choices") or []
        if not choices:
            raise Upstream("the reply has no choices")
        return (choices[0].get("message") or {}).get("content") or ""
