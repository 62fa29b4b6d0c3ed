"""Language identification by the nearest of several centroids per language.

A text is the vector of its hashed byte n-grams (1 + log tf, times idf, length
1), over the whole lower-cased text.  Each language has several centroids,
clustered from a bounded sample of labelled texts: at most `sample` different
texts a language, those of the smallest hash, so it depends neither on order
nor on how often a text is repeated; texts of over SAMPLE_BYTES, and what goes
beyond SAMPLE_BYTES a language, are not sampled, and of more than LABELS
labels the most frequent are taught.  Centroids come from the longer three
quarters of the sample, as the shortest texts say little.  idf comes from all
documents.  A document gets the language of the centroid with the highest
cosine and is rejected when it lies further from it than texts of that length
and language do in the sample.

Defined results: null, empty and letterless texts have language `und`,
similarity 0, and are rejected; ties go to the language that sorts first; rows
with a null or empty label are classified but teach nothing; with no labelled
text at all everything is `und` and rejected; texts of any length are
classified whole; repeated rows get equal results; an empty table gives an
empty result.  Other columns are kept; those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import bpe
from loomspark.llm.vec import lean, mix, pieces, utf8

DIMS = 4096
ORDERS = (2, 3, 4)
SAMPLE = 300
CENTROIDS = 4
#: Bounds of the sample: bytes of its texts a language, and number of languages.
SAMPLE_BYTES, LABELS = 4 << 20, 256
#: Share of sample texts of a length class, at the far end, beyond which the limit is drawn, and how far beyond.
FAR, SLACK = 0.02, 0.6
PIECE = 1 << 19
_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _vectors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (rows x DIMS, float32) and the number of n-grams of each row; digits, signs and spaces all count as one blank."""
    n = len(off) - 1
    clean = np.where(_LETTER[data] == 1, data, 32).astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.zeros(n * DIMS, np.float32)
    blank = clean == 32
    for order in ORDERS:
        m = len(clean) - order + 1
        if m <= 0:
            continue
        code = clean[:m].copy()
        for k in range(1, order):
            code = code << np.uint64(8) | clean[k : k + m]
        # no n-gram crosses rows or holds two blanks side by side
        ok = row[:m] == row[order - 1 :]
        for k in range(order - 1):
            ok &= ~(blank[k : k + m] & blank[k + 1 : k + 1 + m])
        h = mix(code[ok] + np.uint64(order << 40)) >> np.uint64(64 - 12)
        counts += np.bincount(row[:m][ok] * DIMS + h.astype(np.int64), minlength=n * DIMS).astype(np.float32)
    counts = counts.reshape(n, DIMS)
    return counts, counts.sum(1)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, out=counts)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: Least cosine by centroid owner and length class (log2 of the number of n-grams).
    limit: np.ndarray


CLASSES = 40


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), CLASSES - 1)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by the farthest-first rule so that it is repeatable."""
    centre = x.mean(0)
    seeds = [int(np.argmax(x @ centre))]
    nearest = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, 1)
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(norm > 0, norm, 1)
    return c


def fit(texts: list[str], labels: list[str], idf: np.ndarray, centroids: int = CENTROIDS) -> Model:
    """Clusters the sample; the limits come from its texts and from cuts of them at every power of two of their length."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros((0, CLASSES), np.float32))
    at = np.array([languages.index(x) for x in labels])
    # the shortest texts say little about a language: centroids come from the longer three quarters
    counts, n = _features(texts)
    x = _weigh(counts, idf)
    found, owner = [], []
    for j in range(len(languages)):
        own = np.flatnonzero(at == j)
        own = own[n[own] >= np.quantile(n[own], 0.25)]
        c = _cluster(x[own], centroids)
        found.append(c)
        owner += [j] * len(c)
    c = np.concatenate(found).astype(np.float32)
    owner_of = np.array(owner)
    limit = np.zeros((len(languages), CLASSES), np.float32)
    cosines: dict[tuple[int, int], list[float]] = {}
    size = 8
    while size <= max(map(len, texts), default=0) * 2:
        cut, whose = [], []
        for t, j in zip(texts, at.tolist()):
            if len(t) >= size // 2:
                for start in range(0, max(1, len(t) - size + 1), max(size, len(t) // 4)):
                    cut.append(t[start : start + size])
                    whose.append(j)
        for i in range(0, len(cut), 256):
            counts, m = _features(cut[i : i + 256])
            best = _weigh(counts, idf) @ c.T
            for row, (j, k) in enumerate(zip(whose[i : i + 256], _length_class(m).tolist())):
                cosines.setdefault((j, k), []).append(float(best[row][owner_of == j].max()))
        size *= 2
    for j in range(len(languages)):
        for k in range(CLASSES):
            if seen := cosines.get((j, k)):
                limit[j, k] = max(0.0, np.quantile(seen, FAR) * SLACK)
        # classes without sample texts take the limit of the nearest shorter class
        for k in range(1, CLASSES):
            if (j, k) not in cosines:
                limit[j, k] = limit[j, k - 1]
    return Model(languages, idf, c, owner_of, limit)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = [_vectors(*utf8(b.column(0))) for b in pieces(pa.record_batch([pa.array(texts, pa.string())], ["text"]), most=PIECE)]
    return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of texts and, for each dimension, of texts that have it: summed over all of df; DIMS rows reach the driver."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for b in pieces(batch, "t", PIECE):
                counts, _ = _vectors(*utf8(b.column(0)))
                total += (counts > 0).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)), pa.array(np.append(n, total))], names=["dim", "n"])

    rows = df.select(F.lower(F.col(f"`{text}`")).alias("t")).mapInArrow(lean(run), "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    got = {r["dim"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(DIMS)], np.int64)


def train(df: DataFrame, label: str = "lang", text: str = "text", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """idf over all of df, centroids from at most `sample` labelled rows a language."""
    n, frequency = document_frequencies(df, text)
    idf = (np.log((1 + n) / (1 + frequency)) + 0.05).astype(np.float32)
    column = F.col(f"`{text}`")
    labelled = df.where(F.col(f"`{label}`").isNotNull() & (F.trim(f"`{label}`") != "") & (F.length(F.trim(column)) > 0)).select(F.col(f"`{label}`").cast("string").alias("label"), F.xxhash64(column).alias("h"), F.octet_length(column).alias("size"), F.lower(column).alias("t"))
    labelled = labelled.where(F.col("size") <= SAMPLE_BYTES)
    # counted by sketches that combine on the map side; a share of each label's texts that holds the sample several times over is all that is ranked
    sizes = labelled.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    if not sizes:
        return fit([], [], idf, centroids)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["label"], min(1.0, 8.0 * sample / max(1, r["n"])))))
    some = labelled.where(F.pmod("h", F.lit(1 << 30)) < F.coalesce(share[F.col("label")], F.lit(0.0)) * (1 << 30))
    # copies go before ranking, on the map side first; no text is shuffled until the sample is known
    each = some.groupBy("label", "h").agg(F.max("size").alias("size"))
    by = Window.partitionBy("label").orderBy("h")
    chosen = each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample).withColumn("bytes", F.sum("size").over(by)).where(F.col("bytes") <= SAMPLE_BYTES).select("label", "h", "r")
    # at most `sample` rows a language, so sending them everywhere is bounded
    rows = some.select("label", "h", "t").join(F.broadcast(chosen), ["label", "h"]).groupBy("label", "r").agg(F.min("t").alias("t")).orderBy("label", "r").collect()
    return fit([r["t"] for r in rows], [r["label"] for r in rows], idf, centroids)


_OUT = (T.StructField("language", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("rejected", T.BooleanType()))


def predict(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language numbers (-1: none), cosines, and whether each is rejected."""
    n = len(off) - 1
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.ones(n, bool)
    counts, size = _vectors(data, off)
    cosine = _weigh(counts, model.idf) @ model.centroids.T
    best = np.stack([cosine[:, model.owner == j].max(1) for j in range(len(model.languages))], 1)
    at = np.argmax(best, 1)
    value = best[np.arange(n), at].astype(np.float64)
    none = size == 0
    rejected = none | (value < model.limit[at, _length_class(size)])
    return np.where(none, -1, at), np.where(none, 0.0, value), rejected


def classify(df: DataFrame, model: Model, text: str = "text", only_kept: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds language, similarity and rejected; no shuffle. only_kept leaves rejected rows out and adds nothing."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    lowered = "lowered text of the row"
    new = () if only_kept else _OUT
    names = {f.name for f in new}
    keep = [c for c in df.columns if c not in names and c not in drop]
    schema = T.StructType([*(df.schema[c] for c in keep), *new])

    def run(batches):
        m = shared.value
        languages = np.array([*m.languages, "und"], object)
        for batch in batches:
            for b in pieces(batch, lowered, PIECE):
                at, value, rejected = predict(m, *utf8(b.column(b.schema.get_field_index(lowered))))
                if only_kept:
                    rows = bpe._replace(b, keep, {}, schema)
                    yield rows.filter(pa.array(~rejected))
                else:
                    yield bpe._replace(b, keep, {"language": pa.array(languages[at], pa.string()), "similarity": pa.array(np.round(value, 6)), "rejected": pa.array(rejected)}, schema)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.lower(F.col(f"`{text}`")).alias(lowered)).mapInArrow(lean(run), schema)
