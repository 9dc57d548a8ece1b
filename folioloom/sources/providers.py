"""Model providers as interfaces, with deterministic stand-ins for work without a network.

A provider gives a Column, evaluated in Arrow batches by a vectorised function, one
client per worker. Failures of single rows are values, not failed jobs.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbedProvider(ABC):
    """``batch`` texts go into one call: 32 unless a service takes more (96) or fewer (10).

    Vectors are cut to ``dimensions``; ``prefix`` goes before each text.
    """

    batch = 32
    dimensions = 64
    prefix = ""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def column(self, text: Column) -> Column:
        provider = self

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in parts:
                texts = [provider.prefix + (t or "") for t in s]
                out: list[list[float]] = []
                for at in range(0, len(texts), provider.batch):
                    out += provider.embed(texts[at : at + provider.batch])
                yield pd.Series([[float(x) for x in v[: provider.dimensions]] for v in out])

        return run(text)


class RerankProvider(ABC):
    @abstractmethod
    def rerank(self, query: str, documents: list[str]) -> list[float]: ...

    def score(self, query: str, text: Column) -> Column:
        provider = self

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(provider.rerank(query, s.fillna("").tolist()), dtype=float)

        return run(text)


class PageReader(ABC):
    """Optical character recognition: page images to Markdown."""

    @abstractmethod
    def read(self, image: bytes) -> str: ...

    def pages(self, images: DataFrame) -> DataFrame:
        """doc_id, page_num_1, markdown, error of (doc_id, page_num_1, content)."""
        reader = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, errors = [], []
                for content in b["content"]:
                    try:
                        texts.append(reader.read(bytes(content)))
                        errors.append(None)
                    except Exception as e:
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"doc_id": b["doc_id"], "page_num_1": b["page_num_1"], "markdown": texts, "error": errors})

        return images.select("doc_id", "page_num_1", "content").mapInPandas(run, "doc_id string, page_num_1 int, markdown string, error string")


class ChatProvider(ABC):
    @abstractmethod
    def complete(self, messages: list[dict], max_tokens: int = 512, temperature: float = 0.0, tools: list[dict] | None = None) -> dict: ...

    def count_tokens(self, messages: list[dict], tools: list[dict] | None = None) -> int:
        import json

        return int(len(json.dumps([messages, tools or []])) / 3.5) + 100


class HashEmbedder(EmbedProvider):
    """Signed hashes of words, normalised: equal texts have equal vectors, shared words bring them nearer.

    Words whose hashes cancel out are hashed as one, so that only a text without words has no length.
    """

    def __init__(self, dimensions: int = 64, prefix: str = "", batch: int = 32):
        self.dimensions, self.prefix, self.batch = dimensions, prefix, batch

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            words = t.lower().split()
            for w in words:
                self._add(v, w)
            if words and not v.any():
                self._add(v, " ".join(words))
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    def _add(self, v: np.ndarray, w: str) -> None:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % self.dimensions] += 1 if h >> 63 else -1


class OverlapReranker(RerankProvider):
    """The share of the query's words that a text has."""

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [round(len(q & set(d.lower().split())) / len(q), 6) if q else 0.0 for d in documents]


class PlainReader(PageReader):
    """Pages that are text already."""

    def read(self, image: bytes) -> str:
        return image.decode()


class EchoChat(ChatProvider):
    """Answers with the first context marker; for tests of the loop around it."""

    def complete(self, messages: list[dict], max_tokens: int = 512, temperature: float = 0.0, tools: list[dict] | None = None) -> dict:
        return {"role": "assistant", "content": f"{messages[-1]['content'][:max_tokens]} [1]"}


class SpanReader(ABC):
    """Reading of PDF files into text spans and images; no library for it is assumed."""

    @abstractmethod
    def read(self, content: bytes) -> Iterator[dict]:
        """Rows with page_num_1, kind (span or image), text, font_size, x0, y0, x1, y1, direction, width, height."""

    def spans(self, files: DataFrame) -> DataFrame:
        """Spans of (path, content); a file that can't be read gives one row with its error."""
        reader = self
        names = ["path", "page_num_1", "kind", "text", "font_size", "x0", "y0", "x1", "y1", "direction", "width", "height", "error"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    try:
                        rows = [{"path": path, **r} for r in reader.read(bytes(content))]
                    except Exception as e:
                        rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                    yield pd.DataFrame(rows, columns=names)

        return files.select("path", "content").mapInPandas(run, "path string, page_num_1 int, kind string, text string, font_size double, x0 double, y0 double, x1 double, y1 double, direction string, width int, height int, error string")
