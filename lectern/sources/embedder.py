"""Embedding providers: one interface, retries with a growing wait, failures by batch."""

from __future__ import annotations

import hashlib
import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 256
#: Statuses worth another attempt; 0 stands for no answer at all.  Fixed values.
RETRYABLE = frozenset({0, 408, 425, 429, 500, 502, 503, 504})
LARGEST = 16 << 20


class EmbeddingError(RuntimeError):
    def __init__(self, message: str, status: int = 0) -> None:
        super().__init__(message)
        self.status = status


def backoff_seconds(attempt: int) -> float:
    """A quarter of a second, doubled each time, at most four."""
    return min(4.0, 0.25 * 2**attempt)


def with_retries(call: Callable[[], list], wanted: int, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> list:
    """The vectors of one batch; an answer with another number of vectors counts as a failure."""
    for k in range(attempts):
        try:
            out = call()
            if len(out) == wanted:
                return out
            error = EmbeddingError(f"{len(out)} vectors for {wanted} texts")
        except EmbeddingError as e:
            error = e
            if e.status not in RETRYABLE:
                raise
        if k + 1 < attempts:
            sleep(backoff_seconds(k))
    raise error


def vectors_of(body: str) -> list[list[float]]:
    """Vectors of an answer in either of the two common forms, in order of appearance."""
    data = json.loads(body)
    if "embeddings" in data:
        return data["embeddings"]
    if "data" in data:
        return [d["embedding"] for d in data["data"]]
    raise EmbeddingError("the answer holds no vectors")


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors from word hashes: no service, for tests and offline runs."""

    dim: int = 64

    def available(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """POST {"model", "input"} to an endpoint such as .../api/embed or .../v1/embeddings."""

    url: str
    model: str
    timeout: float = 120.0
    key: str = ""

    def available(self) -> bool:
        """Whether something takes a connection there within two seconds."""
        try:
            at = urllib.parse.urlsplit(self.url)
            socket.create_connection((at.hostname or "", at.port or (443 if at.scheme == "https" else 80)), 2).close()
            return True
        except (OSError, ValueError):
            return False

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, body, headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                if r.status != 200:
                    raise EmbeddingError(f"status {r.status}", r.status)
                raw = r.read(LARGEST + 1)
        except urllib.error.HTTPError as e:
            raise EmbeddingError(str(e), e.code) from e
        except OSError as e:
            raise EmbeddingError(str(e)) from e
        if len(raw) > LARGEST:
            raise EmbeddingError("the answer is too large", 413)
        return vectors_of(raw.decode())


def first_available(providers: Iterable) -> object | None:
    """The first provider that answers; None leaves the corpus without vectors."""
    return next((p for p in providers if p.available()), None)


#: Where services listen by default.  Fixed values.
DEFAULT_URLS = ("http://127.0.0.1:11434/api/embed", "http://127.0.0.1:8000/v1/embeddings")


def usual_providers(url: str = "", model: str = "", key: str = "") -> list[HttpEmbedder]:
    """The configured service, if any, then those at the usual places of this machine (without the key)."""
    return ([HttpEmbedder(url, model, key=key)] if url else []) + [HttpEmbedder(u, model) for u in DEFAULT_URLS if u != url]


def dimension(provider) -> int | None:
    """The length of the provider's vectors; None if it has no answer."""
    try:
        return len(provider.embed(["dimension probe"])[0])
    except (EmbeddingError, IndexError):
        return None


def embed(chunks: DataFrame, provider, id_col: str = "chunk_id", text_col: str = "text", batch: int = BATCH, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(chunk_id, embedding, failed): vectors of all chunks; a batch that fails for good has nulls and ``failed``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column(1).to_pylist()]
                try:
                    vectors, failed = with_retries(lambda: provider.embed(texts), len(texts), sleep=sleep), False
                except EmbeddingError:
                    vectors, failed = [None] * len(texts), True
                yield pa.record_batch([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([failed] * len(texts))], names=["chunk_id", "embedding", "failed"])

    return chunks.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "chunk_id long, embedding array<float>, failed boolean")
