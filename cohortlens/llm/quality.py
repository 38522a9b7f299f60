"""Quality classifier on random-indexing word vectors.

Every token has a sparse ternary index vector drawn from its hash. The vector
of a word is the sum of the index vectors beside it over a bounded sample of
labelled documents; rare and unseen words share the vector of their shape
(capitals, digits, runs of marks ...). A document is the mean of its token
vectors, which a two-layer network scores; the temperature of its
probabilities is calibrated on a part of the sample that the network does not
see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_slices
from .text import all_rows, spaced_pieces

DIM, NONZERO, WINDOW = 64, 6, 2
SAMPLE_ROWS = 4_000
VOCABULARY = 8_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 300, 0.02, 1e-4
THRESHOLD = 0.3
SHAPES = ("<space>", "<lower>", "<title>", "<upper>", "<mixed>", "<digits>", "<mark>", "<marks>")


def shape(token: str) -> str:
    core = token.strip()
    if not core:
        return "<space>"
    if core[0].isalpha() or (core[0] == "'" and len(core) > 1 and core[1].isalpha()):
        return ("<lower>" if core.islower() else "<upper>" if core.isupper() and len(core) > 1
                else "<title>" if core[0].isupper() and not any(c.isupper() for c in core[1:]) else "<mixed>")
    if core[0].isnumeric():
        return "<digits>"
    return "<mark>" if len(core) == 1 else "<marks>"


def token_of(piece: str) -> str:
    return piece.strip() or "<space>"


def index_vector(token: str) -> np.ndarray:
    """Sparse ternary vector, a function of the token alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token, 7))
    v = np.zeros(DIM, np.float32)
    at = rng.choice(DIM, NONZERO, replace=False)
    v[at] = np.where(np.arange(NONZERO) % 2 == 0, 1, -1)
    return v


def _own_pieces(text: str) -> list[str]:
    """Pieces of a text outside the array segmentation: words and single other characters."""
    import re

    return re.findall(r" ?[^\W\d_]+| ?\d+| ?[^\w\s]+|_+|\s+", text)


@dataclass(frozen=True)
class Model:
    vocabulary: tuple[str, ...]
    vectors: np.ndarray  # words, then shapes
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        logit = np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1.0 / (1.0 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


def _codes(texts: pa.Array, index: dict[str, int], n_words: int, known: dict[str, int] | None = None):
    """Vector rows of each text's tokens, the rows' ends, and the tokens' own codes.

    Unknown words take their shape's row.
    """
    pieces = all_rows(texts, spaced_pieces, _own_pieces)
    known = {} if known is None else known
    for p in pieces.words():
        if p not in known:
            word = index.get(token_of(p))
            known[p] = word if word is not None else n_words + SHAPES.index(shape(p))
    rows = np.fromiter((known[p] for p in pieces.words()), np.int64, len(pieces.values))
    return (rows[pieces.codes] if len(rows) else np.zeros(0, np.int64)), pieces.ends, pieces.codes


def _pool(codes: np.ndarray, ends: np.ndarray, tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean vector, share of each shape row, and how its tokens repeat; empty: all zero."""
    n_words = len(vectors) - len(SHAPES)
    out = np.zeros((len(ends) - 1, vectors.shape[1] + len(SHAPES) + 3))
    for r, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
        if e > s:
            mine = codes[s:e]
            rows, counts = np.unique(mine, return_counts=True)
            share = counts / (e - s)
            out[r, :vectors.shape[1]] = share @ vectors[rows]
            shapes = rows >= n_words
            out[r, vectors.shape[1] + rows[shapes] - n_words] = share[shapes]
            own = tokens[s:e]
            kinds = np.unique(own, return_counts=True)[1]
            out[r, -3:] = np.mean(own[1:] == own[:-1]) if e - s > 1 else 0, kinds.max() / (e - s), len(kinds) / (e - s)
    return out


def learnable():
    """Rows whose labels may be learnt from."""
    return F.coalesce(~held_out(), F.lit(False))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model | None:
    """Model from at most ``sample_rows`` labelled documents (smallest hashes of the id), whole texts.

    None if no labelled row remains. A document with several labels or texts
    takes the smallest.
    """
    chosen = (labels.where(learnable() & F.col("quality").isNotNull()).groupBy("doc_id")
              .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    sample = materialise(
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).repartition(8, "doc_id"), "quality-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_slices(b.column(0)):
                pieces = all_rows(b.column(0).slice(i, j - i), spaced_pieces, _own_pieces)
                n = np.bincount(pieces.codes, minlength=len(pieces.values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([token_of(p) for p in pieces.words()], pa.string()), pa.array(n.astype(np.int64))],
                    names=["token", "n"])

    words = tuple(r[0] for r in sample.select("text").mapInArrow(count, "token string, n bigint").groupBy("token")
                  .agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "token").limit(vocabulary).collect())
    index = {w: i for i, w in enumerate(words)}
    own = np.stack([index_vector(w) for w in (*words, *SHAPES)])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(own.shape, np.float32)
        for b in batches:
            for i, j in row_slices(b.column(0), 1 << 20):
                codes, ends, _ = _codes(b.column(0).slice(i, j - i), index, len(words))
                row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                for d in range(1, WINDOW + 1):
                    same = row[d:] == row[:-d]
                    for a, c in ((codes[d:][same], codes[:-d][same]), (codes[:-d][same], codes[d:][same])):
                        pair, n = np.unique(a * len(own) + c, return_counts=True)
                        np.add.at(total, pair // len(own), own[pair % len(own)] * n[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    # one matrix from each of the eight partitions of the sample
    parts = sample.select("text").mapInArrow(contexts, "part binary").collect()
    vectors = np.sum([np.frombuffer(p[0], np.float32).reshape(own.shape) for p in parts], axis=0)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    vectors = vectors + 0.5 * own / np.sqrt(NONZERO)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in row_slices(b.column(2)):
                x = _pool(*_codes(b.column(2).slice(i, j - i), index, len(words)), vectors)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).cast(pa.int64()),
                     pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = sample.select("doc_id", "quality", "text").mapInArrow(
        features, "doc_id bigint, quality bigint, x array<double>").orderBy("doc_id").collect()
    if not rows:
        return None
    return _train(words, vectors, np.array([r[2] for r in rows]), np.array([float(r[1] != 0) for r in rows]))


def _train(words, vectors, x, y) -> Model:
    """Two layers by Adam on four fifths of the sample, the temperature on the last fifth."""
    rng = np.random.default_rng(11)
    held = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    a, t = z[~held], y[~held]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(a @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = (p - t) / len(a)
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [a.T @ dh + DECAY * params[0], dh.sum(axis=0), h.T @ d + DECAY * params[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    check, truth = (z[held], y[held]) if held.any() else (z, y)
    logit = np.tanh(check @ params[0] + params[1]) @ params[2] + params[3]
    options = np.geomspace(0.25, 8, 41)
    losses = [np.mean(np.logaddexp(0, np.where(truth > 0, -logit, logit) / temp)) for temp in options]
    return Model(tuple(words), vectors.astype(np.float32), mean, scale, *params[:3], float(params[3][0]),
                 float(options[int(np.argmin(losses))]))


@lru_cache(maxsize=2)
def _index(words: tuple[str, ...]) -> dict[str, int]:
    return {w: i for i, w in enumerate(words)}


def _scorer(model: Model | None):
    def score(texts: pa.Array, known: dict[str, int]) -> np.ndarray:
        if model is None:
            return np.ones(len(texts))
        if len(known) > 100_000:
            known.clear()
        return model.scores(_pool(*_codes(texts, _index(model.vocabulary), len(model.vocabulary), known), model.vectors))

    return score


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored like a text without tokens. Without a
    model (nothing to learn from) every score is 1. A null id counts as held
    out; repeated rows give equal rows; extra columns are ignored.
    """
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for i, j in row_slices(b.column(2)):
                s = score(b.column(2).slice(i, j - i), known)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s),
                     pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.coalesce(held_out(), F.lit(True)).alias("held_out"), "text")
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score reaches ``threshold``; no shuffle."""
    score, at = _scorer(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for i, j in row_slices(b.column(at)):
                part = b.slice(i, j - i)
                yield part.filter(pa.array(score(part.column(at), known) >= threshold))

    return docs.mapInArrow(run, docs.schema)
