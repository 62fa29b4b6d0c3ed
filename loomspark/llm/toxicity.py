"""A toxicity classifier that is penalised for reacting to who is mentioned.

Features are the words of a text and their beginnings (4 to 7 bytes), as
64-bit hashes, present or not.  A sparse logistic regression is fitted on the
driver to a bounded sample of labelled documents (`sample` rows of each
class).  Beside the usual loss it minimises, over sentences of the sample, the
squared change of score when an identity term is swapped for another, or a
neutral mention of one is put in, so that naming a group moves no score while
the rest of the sentence stays the same.

Every text is scored whole: the sum of the weights of the features it has.
The decision threshold is the best one on a held-out fifth of the sample.

Defined results: null and wordless texts have score 0 and are not toxic;
repeated rows get equal scores; rows with a null doc_id are scored; labels
that are null, repeated or without a document teach nothing (of repeated ones
one counts); without labels of both classes every score is 0; texts of any
length are scored whole, but those of over SAMPLE_BYTES are not in the sample;
an empty table gives an empty result. Only doc_id is kept of the input, so no
name can clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import nearjoin
from loomspark.llm.vec import lean, pieces, span_hashes, utf8, words

SAMPLE = 3000
SAMPLE_BYTES = 1 << 20
#: Features of the sample that are weighed, those whose presence differs most between the classes.
CANDIDATES = 6000
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the penalty on counterfactual score changes, and of the absolute weights.
FAIRNESS, SPARSITY = 4.0, 0.0005
ROUNDS = 300
#: How many times as frequent a feature must be in toxic documents.
LIFT = 3.0
#: Similarity from which a labelled text counts as a copy of another.
NEAR = 0.3
#: Sentences of the sample that a mention is put into.
MENTIONS = 4000

#: Terms that may be swapped for each other, by what kind of group they name.
IDENTITY: list[list[str]] = [
    "women men girls boys women's femmes hommes filles garçons frauen männer mädchen jungen mujeres hombres".split(),
    "muslims christians jews hindus buddhists atheists musulmans chrétiens juifs muslime christen juden musulmanes cristianos judíos".split(),
    "black white asian latino arab african european american noirs blancs schwarze weiße asiaten negros blancos asiáticos".split(),
    "gay lesbian straight bisexual transgender queer homosexuels lesbiennes schwule lesben homosexuales lesbianas".split(),
    "immigrants refugees foreigners natives immigrés réfugiés étrangers einwanderer flüchtlinge ausländer inmigrantes refugiados extranjeros".split(),
    "disabled deaf blind elderly old young handicapés aveugles behinderte blinde alte discapacitados ciegos ancianos".split(),
]
_GROUP = {term: k for k, terms in enumerate(IDENTITY) for term in terms}


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words and of their beginnings, with repeats."""
    start, end, row = words(data, off)
    out, rows = [span_hashes(data, start, end)], [row]
    for n in BEGINNINGS:
        i = np.flatnonzero(end - start > n)
        # another hash than that of the whole word of these letters
        out.append(span_hashes(data, start[i], start[i] + n) ^ np.uint64(0x5851F42D4C957F2D + n))
        rows.append(row[i])
    return np.concatenate(out), np.concatenate(rows)


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unique (feature, row) of lower-cased texts, ordered by row."""
    h, r, base = [], [], 0
    for b in pieces(pa.record_batch([pa.array(texts, pa.string())], ["text"]), most=1 << 18):
        x, y = features(*utf8(b.column(0)))
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
        h.append(x[new])
        r.append((y[new] + base).astype(np.int32))
        base += b.num_rows
    return (np.concatenate(h), np.concatenate(r)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def counterfactuals(texts: list[str], most: int = MENTIONS, seed: int = 7) -> list[tuple[str, str]]:
    """(sentence, same sentence naming another group): every swap of a term in a sentence for the next of its kind, and neutral mentions put into up to `most` further sentences."""
    rng = np.random.default_rng(seed)
    terms = [t for group in IDENTITY for t in group]
    out, plain = [], []
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text):
            tokens = sentence.split()
            named = [i for i, w in enumerate(tokens) if w in _GROUP]
            for i in named:
                group = IDENTITY[_GROUP[tokens[i]]]
                for step in (1, len(group) // 2, len(group) - 1):
                    other = group[(group.index(tokens[i]) + step) % len(group)]
                    if other != tokens[i]:
                        out.append((" ".join(tokens), " ".join([*tokens[:i], other, *tokens[i + 1 :]])))
            if not named and len(tokens) >= 2:
                plain.append(tokens)
    for k in (range(len(plain)) if len(plain) <= most else rng.choice(len(plain), most, replace=False)):
        tokens, at = plain[int(k)], int(rng.integers(0, len(plain[int(k)]) + 1))
        out.append((" ".join(tokens), " ".join([*tokens[:at], terms[int(rng.integers(0, len(terms)))], *tokens[at:]])))
    return out


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float


EMPTY = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct(texts: list[str], toxic: list[int]) -> list[int]:
    """Places of the texts without near copies (Jaccard similarity of word trigrams at least NEAR) of an earlier one of their class: a text copied many times would make its chance words look telling."""
    holders: dict[tuple[int, int], list[int]] = {}
    kept: dict[int, np.ndarray] = {}
    out, i = [], 0
    for b in pieces(pa.record_batch([pa.array(texts, pa.string())], ["text"]), most=1 << 18):
        code, row = nearjoin.ngrams(*utf8(b.column(0)))
        edge = np.searchsorted(row, np.arange(b.num_rows + 1))
        keys = (nearjoin.labels(nearjoin.signatures(code, row, b.num_rows), 32, 4, 4) >> np.uint64(nearjoin.FINE)).tolist()
        for k, own in enumerate(keys):
            grams = np.unique(code[edge[k] : edge[k + 1]])
            # the tries only say which texts to compare
            likely = sorted({j for key in own for j in holders.get((toxic[i], key), ())}) if len(grams) else []
            near = False
            for j in likely:
                both = len(np.intersect1d(grams, kept[j], assume_unique=True))
                if both >= NEAR * (len(grams) + len(kept[j]) - both):
                    near = True
                    break
            if not near:
                out.append(i)
                if len(grams):
                    kept[i] = grams
                    for key in own:
                        holders.setdefault((toxic[i], key), []).append(i)
            i += 1
    return out


class _Sparse:
    """Rows of column numbers, each with value 1 or the given one."""

    def __init__(self, row, column, value, rows: int, columns: int):
        self.row, self.column, self.value, self.rows, self.columns = row, column, value, rows, columns

    def dot(self, w):
        return np.bincount(self.row, self.value * w[self.column], self.rows).astype(np.float64)

    def back(self, v):
        return np.bincount(self.column, self.value * v[self.row], self.columns).astype(np.float64)


def _select(h: np.ndarray, r: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    ok = keys[at] == h
    return at[ok], r[ok]


def fit(texts: list[str], toxic: list[int], fairness: float = FAIRNESS, sparsity: float = SPARSITY, candidates: int = CANDIDATES, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the sample; rows 0, 5, 10, ... are held out for the threshold."""
    y = np.array(toxic, np.float64)
    if len(set(toxic)) < 2:
        return EMPTY
    lowered = [t.lower() for t in texts]
    once = distinct(lowered, toxic)
    lowered, y = [lowered[i] for i in once], y[once]
    h, r = _of(lowered)
    held = np.zeros(len(lowered), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::5]] = True
    if min((y[~held] == k).sum() for k in (0, 1)) == 0:
        held[:] = False
    train = ~held
    # candidates: the features whose presence differs most between the classes, and all identity terms
    keys = np.unique(h)
    code = np.searchsorted(keys, h).astype(np.int32)
    n1, n0 = (y[train] == 1).sum(), (y[train] == 0).sum()
    mine = train[r]
    in1 = np.bincount(code[mine & (y[r] == 1)], minlength=len(keys))
    in0 = np.bincount(code[mine & (y[r] == 0)], minlength=len(keys))
    p1, p0, p = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1), (in1 + in0 + 1) / (n1 + n0 + 2)
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[in1 + in0 < min(3, n1)] = 0
    # what is merely more frequent in toxic texts, as long texts have more of everything, is no evidence
    z[p1 < LIFT * p0] = 0
    best = keys[np.argsort(-z, kind="stable")[:candidates][: int((z > 0).sum())]]
    del code, mine, in1, in0, p1, p0, p, z
    identity = _of([w for group in IDENTITY for w in group])[0]
    keys = np.unique(np.concatenate([best, identity]))
    column, row = _select(h, r, keys)
    del h, r
    place = np.cumsum(train) - 1
    ok = train[row]
    x = _Sparse(place[row[ok]], column[ok], 1.0, int(train.sum()), len(keys))
    target = y[train]
    weight = np.where(target == 1, 0.5 / max(1, n1), 0.5 / max(1, n0))
    # counterfactual pairs: the difference of their features
    pairs = counterfactuals([t for t, m in zip(lowered, train) if m])
    if pairs and fairness > 0:
        a, b = (_of([p[k] for p in pairs]) for k in (0, 1))
        (ca, ra), (cb, rb) = _select(*a, keys), _select(*b, keys)
        d = _Sparse(np.concatenate([ra, rb]), np.concatenate([ca, cb]), np.concatenate([-np.ones(len(ca)), np.ones(len(cb))]), len(pairs), len(keys))
    else:
        d = None

    def gradient(w, b):
        g = weight * (_sigmoid(x.dot(w) + b) - target)
        out = x.back(g)
        if d is not None:
            out += 2 * fairness / d.rows * d.back(d.dot(w))
        return out, g.sum()

    # step from the largest curvature, by a few power iterations
    v, top = np.ones(len(keys)) / np.sqrt(len(keys)), 1.0
    for _ in range(12):
        u = 0.25 * x.back(weight * x.dot(v)) + (2 * fairness / d.rows * d.back(d.dot(v)) if d is not None else 0)
        top = max(float(np.linalg.norm(u)), 1e-9)
        v = u / top
    step = 1 / (1.3 * top + 0.25)
    w, b = np.zeros(len(keys)), 0.0
    w_at, b_at, t = w, b, 1.0
    for _ in range(rounds):
        gw, gb = gradient(w_at, b_at)
        new = w_at - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        nb = b_at - step * gb
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = new + (t - 1) / t_new * (new - w), nb + (t - 1) / t_new * (nb - b)
        w, b, t = new, nb, t_new
    score = np.bincount(row, w[column], len(lowered)) + b
    judged = held if held.any() else train
    order = np.argsort(-score[judged], kind="stable")
    s, label = score[judged][order], y[judged][order]
    hits = np.cumsum(label)
    # the F measure that counts precision twice: a clean text should not be lost to noise
    value = 1.25 * hits / (np.arange(1, len(s) + 1) + 0.25 * label.sum())
    # no cut between equal scores
    value[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(value))
    threshold = (s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1e-6
    used = w != 0
    return Model(keys[used], w[used], float(b), float(_sigmoid(np.array([threshold]))[0]))


def score(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of lower-cased texts, and whether each has words."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(n), np.zeros(n, bool)
    h, r = features(data, off)
    has = np.zeros(n, bool)
    has[r] = True
    total = np.full(n, model.bias)
    if len(model.keys):
        maybe = np.zeros(1 << 16, bool)
        maybe[(model.keys >> np.uint64(48)).astype(np.int64)] = True
        i = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
        column, row = _select(h[i], r[i], model.keys)
        both = np.unique(row.astype(np.int64) * len(model.keys) + column)
        total += np.bincount(both // len(model.keys), model.weights[both % len(model.keys)], n)
    return np.where(has, _sigmoid(total), 0.0), has


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", **options) -> Model:
    """Fits to at most `sample` labelled documents of each class, those whose ids hash lowest."""
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return EMPTY
    # a share that holds the sample several times over is all that is ranked
    share = F.when(F.col("toxic") == 1, min(1.0, 8.0 * sample / sizes[1])).otherwise(min(1.0, 8.0 * sample / sizes[0]))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    chosen = known.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "toxic", "rank")
    # the chosen labels number at most twice `sample`, so sending them everywhere is bounded
    found = docs.where(F.octet_length(F.col(text)) <= SAMPLE_BYTES).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "toxic", "rank").agg(F.min("text").alias("text")).orderBy("toxic", "rank").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], **options)


def classify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score and whether it reaches the threshold, for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in pieces(batch, "t"):
                s, has = score(m, *utf8(b.column(1)))
                if not len(m.keys):
                    s, has = np.zeros(len(s)), np.zeros(len(s), bool)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 9)), pa.array(has & (s >= m.threshold))], names=["doc_id", "score", "toxic"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("t")).mapInArrow(lean(run), "doc_id bigint, score double, toxic boolean")
