"""Embedders: a model server over HTTP, and a deterministic one for tests and offline use."""

from __future__ import annotations

import contextlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, BATCH, MAX_CHARS = 1024, 24, 8000
Embedder = Callable[[list[str]], list[list[float]]]


class HashingEmbedder:
    """Signed feature hashing of words, scaled to unit length. No model, equal on every machine."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.identity = {"model": "hashed words", "dim": dim}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        from xxhash import xxh64_intdigest

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


class HttpEmbedder:
    """A model server that embeds batches of texts; failed requests and short answers are asked again."""

    def __init__(self, host: str = "http://localhost:11434", model: str = "bge-m3", timeout: float = 120, tries: int = 3, pause: float = 2) -> None:
        self.host, self.model, self.timeout = host, model, timeout
        self.waits = [pause * k for k in range(1, tries)]
        self.identity = {"model": model, "dim": DIM}

    def _ask(self, path: str, body: dict | None, timeout: float) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.host + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read() or b"{}")

    def alive(self) -> bool:
        with contextlib.suppress(OSError, ValueError):
            self._ask("/api/tags", None, 5)
            return True
        return False

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """One request; as many vectors as texts, or an error."""
        found = self._ask("/api/embed", {"model": self.model, "input": texts}, self.timeout).get("embeddings") or []
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} embeddings for {len(texts)} texts")
        return found

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return patiently(lambda: self.vectors(texts), self.waits)


def patiently(call: Callable, waits: list[float]):
    """The call's result; after an error it is made again, once for each wait."""
    waiting = iter(waits)
    while True:
        try:
            return call()
        except (OSError, ValueError) as error:
            pause = next(waiting, None)
            if pause is None:
                raise RuntimeError(f"embedding failed after {len(waits) + 1} tries") from error
            time.sleep(pause)


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Adds the vectors of ``text``, cut to the model's length, in batches."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(t or "")[:MAX_CHARS] for t in part]
            out: list = []
            for k in range(0, len(texts), batch):
                out.extend(embedder(texts[k : k + batch]))
            yield pd.Series(out)

    return rows.withColumn(to, vectors(F.col(text)))
