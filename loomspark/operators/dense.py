"""Dense retrieval: embeddings of groups and cosine similarity."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Turns texts into vectors; instances travel to the workers, so models are loaded on first use."""

    dims: int
    min_score: float

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words, for tests and for places without a model."""

    def __init__(self, dims: int = 256, min_score: float = 0.10):
        self.dims, self.min_score = dims, min_score

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1.0 if h >> 63 else -1.0
        return out


class StaticModelEmbedder:
    """A static embedding model, where model2vec is installed."""

    dims, min_score = 512, 0.10

    def __init__(self, name: str = "minishlab/potion-retrieval-32M"):
        self.name, self.model = name, None

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            from model2vec import StaticModel

            self.model = StaticModel.from_pretrained(self.name)
        return np.asarray(self.model.encode(texts), np.float32)

    def __getstate__(self):
        return {"name": self.name, "model": None}


class ServiceEmbedder:
    """An embedding service, where its client is installed and a key is set."""

    dims, min_score, batch = 3072, 0.25, 2048

    def __init__(self, name: str = "text-embedding-3-large"):
        self.name = name

    def embed(self, texts: list[str]) -> np.ndarray:
        from openai import OpenAI

        client, out = OpenAI(), []
        for i in range(0, len(texts), self.batch):
            out += [d.embedding for d in client.embeddings.create(model=self.name, input=texts[i : i + self.batch]).data]
        return np.asarray(out, np.float32)


def default_embedder() -> Embedder | None:
    """The service if there is a key and a client, else the static model if it is installed, else none."""
    import importlib.util as find

    if os.environ.get("OPENAI_API_KEY") and find.find_spec("openai"):
        return ServiceEmbedder()
    return StaticModelEmbedder() if find.find_spec("model2vec") else None


def embed(df: DataFrame, embedder: Embedder, to_embed: str = "to_embed", contents: str = "contents", name: str = "embedding") -> DataFrame:
    """Adds the vectors of to_embed, or of contents where it is empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embedder.embed(texts.fillna("").tolist()), np.float32)))

    return df.withColumn(name, run(F.coalesce(F.when(F.col(to_embed) != "", F.col(to_embed)), F.col(contents))))


def stale(dims: int, name: str = "embedding") -> Column:
    """Whether a vector is missing or of another model."""
    return F.col(name).isNull() | (F.size(name) != dims)


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length or a value is no number."""
    v = F.transform(vector, lambda x: x.cast("double"))
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * float(np.linalg.norm(np.asarray(query, np.float64)))
    value = dot / F.when(norm > 0, norm).otherwise(1.0)
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def search(df: DataFrame, query: list[float], key: list[str], k: int = 10, min_score: float = 0.0, vector: str = "embedding") -> DataFrame:
    """The k nearest rows that have a vector, and of those the ones of at least min_score."""
    top = df.where(F.col(vector).isNotNull()).withColumn("score", cosine(vector, query)).orderBy(F.desc("score"), *key).limit(k)
    return top.where(F.col("score") >= min_score)
