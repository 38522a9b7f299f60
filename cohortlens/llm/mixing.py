"""Mixing sources to target weights by soft membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives
each document posteriors over the domains. Nonnegative document rates are
then found by projected gradient on least squares: the expected tokens of a
domain, sum over documents of rate x tokens x posterior, shall meet its
target. Each step is one aggregation over a compact table. Steps add up
before the projection, so a document's rate is a function of its posteriors
and of one vector, and no rate is stored, joined or gathered.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise

BUCKETS = 2_048
SAMPLE_PER_DOMAIN = 400
#: bounds of the fit on the driver, whatever the labels hold: rows in all (of 8 KB each), and domains
SAMPLE_IN_ALL = 8_000
MOST_DOMAINS = 64
TOLERANCE = 1e-4
MOST_STEPS = 400  # far above what was seen; targets missed there are reported
RIDGE, LEAST_RIDGE = 1e-3, 1e-9
TEMPER = 0.9  # target weight of a domain: its expected share to this power
HEADROOM = 1.002  # so that soft members of the largest domain keep a rate of at least 1


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, BUCKETS))
        z = x @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return p / p.sum(axis=1, keepdims=True)


def features(text: str | None) -> np.ndarray:
    """Root shares of hashed byte triplets of the whole text."""
    b = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    for at in range(0, max(len(b) - 2, 0), 1 << 20):
        s = b[at:at + (1 << 20) + 2]
        h = (s[:-2] << 16 | s[1:-1] << 8 | s[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(h >> np.uint32(21), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1))


def fit_classifier(docs: DataFrame, labelled: DataFrame, per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """Softmax regression on at most ``per_domain`` rows of ``labelled(doc_id, domain)`` each, whole texts,
    and at most ``SAMPLE_IN_ALL`` over all domains.

    Null domains are no label. Without any label there is one domain, ``all``;
    more than ``MOST_DOMAINS`` are an error. A repeated id is learnt once, by
    its smallest text.
    """
    known = labelled.where("domain is not null and doc_id is not null")
    n_domains = known.select("domain").distinct().count()
    if n_domains > MOST_DOMAINS:
        raise ValueError(f"{n_domains} domains; at most {MOST_DOMAINS} can be mixed")
    chosen = hashed_sample(known, "domain", min(per_domain, SAMPLE_IN_ALL // max(n_domains, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).astype("<f4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["domain", "x"])

    rows = (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text").mapInArrow(run, "domain string, x binary").collect())
    domains = tuple(sorted({r[0] for r in rows})) or ("all",)
    if len(domains) == 1:
        return Classifier(domains, np.zeros((BUCKETS, 1)), np.zeros(1))
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), "<f4").reshape(len(rows), BUCKETS).astype(np.float64)
    y = np.eye(len(domains))[[domains.index(r[0]) for r in rows]]
    w, b, vw, vb = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains)), 0.0, 0.0
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
        vw, vb = 0.9 * vw + x.T @ d + 1e-5 * w, 0.9 * vb + d.sum(axis=0)
        w, b = w - 2.0 * vw, b - 2.0 * vb
    return Classifier(domains, w, b)


def membership(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, n_tokens, posteriors`` per row; a null or empty text has no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = b.column(1).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 256), pa.array([len((t or "").split()) for t in texts], pa.int64()),
                     pa.array(list(classifier.posteriors(texts)), pa.list_(pa.float64()))],
                    names=["doc_id", "n_tokens", "posteriors"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint, posteriors array<double>")


@dataclass(frozen=True)
class Rates:
    """Rates as a function of posteriors: all steps together, projected once."""

    scale: np.ndarray  # tokens of the corpus over the target of each domain
    step: np.ndarray  # sum of the steps so far
    misses: np.ndarray  # expected tokens over the target less one, by domain; -1 without expected tokens

    def __call__(self, posteriors: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - (posteriors * self.scale) @ self.step)

    def report(self, domains: Sequence[str], stated: bool, tolerance: float | None = None) -> None:
        """Names the domains that miss their targets: an error for stated targets, a warning for default ones."""
        over = [(d, m) for d, m in zip(domains, self.misses) if abs(m) >= (TOLERANCE if tolerance is None else tolerance)]
        if over:
            said = "mixing targets are not met; relative misses: " + ", ".join(f"{d} {m:+.3g}" for d, m in over)
            if stated:
                raise ValueError(said)
            warnings.warn(said, stacklevel=3)


@dataclass(frozen=True)
class Weights:
    """Target weights of domains; ``other`` is that of every domain that is not named."""

    by_domain: Mapping[str, float]
    other: float = 1.0

    def targets(self, domains: Sequence[str], expected: np.ndarray) -> np.ndarray:
        """Token targets in these proportions, large enough that no domain shrinks."""
        weights = np.where(expected > 0, [self.by_domain.get(d, self.other) for d in domains], 0)
        if not weights.sum():
            return expected
        return weights * np.max(expected[weights > 0] / weights[weights > 0]) * HEADROOM


def tempered_targets(expected: np.ndarray, temper: float = TEMPER) -> np.ndarray:
    """Token targets with weights ``share ** temper``, large enough that no domain shrinks."""
    weights = np.where(expected > 0, np.power(np.maximum(expected, 1e-300) / max(expected.sum(), 1e-300), temper), 0)
    if not weights.sum():
        return expected
    return weights * np.max(expected[weights > 0] / weights[weights > 0]) * HEADROOM


def solve_rates(members: DataFrame, n_domains: int, targets: np.ndarray | Callable[[np.ndarray], np.ndarray] = tempered_targets,
                tolerance: float = TOLERANCE) -> Rates:
    """Projected gradient from rate 1 with lazy projection, one aggregation a step.

    ``targets`` are tokens per domain, or a function that makes them of the
    expected tokens (default: :func:`tempered_targets`).
    Domains without a target are left out of the fit. It stops when every
    relative miss is below ``tolerance``; targets that no rates meet, or that
    are not met in ``MOST_STEPS``, leave their misses in ``Rates.misses``.
    """
    p = [F.element_at("posteriors", k + 1) for k in range(n_domains)]
    n = F.col("n_tokens").cast("double")
    row = members.agg(F.coalesce(F.sum(n), F.lit(0.0)), *[F.coalesce(F.sum(n * x), F.lit(0.0)) for x in p]).first()
    total, expected = float(row[0]), np.array(row[1:], float)
    wanted = targets(expected) if callable(targets) else np.asarray(targets, float)
    use = (wanted > 0) & (expected > 0)
    scale = np.where(use, total / np.where(use, wanted, 1), 0.0)
    none_there = np.where((wanted > 0) & (expected <= 0) & (total > 0), -1.0, 0.0)

    def sums(step: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Over all documents after ``step``: half the square rate, how far ``step`` lifts a rate
        at most, tokens over targets, and the curvature of the positive rates."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, lift = np.zeros(1 + n_domains + n_domains * n_domains), 0.0
            for f in frames:
                if len(f):
                    q = np.stack(f["posteriors"].to_numpy())
                    tokens, pull = f["n_tokens"].to_numpy(np.float64), (q * scale) @ step
                    rate, mass = np.maximum(0.0, 1.0 - pull), q[:, use].sum(axis=1)
                    held = (tokens > 0) & (mass > 0)
                    lift = max(lift, (-pull[held] / mass[held]).max(initial=0.0))
                    out += np.concatenate([[tokens @ rate**2 / 2], (tokens * rate) @ q,
                                           ((q * (tokens * (rate > 0))[:, None]).T @ q).ravel()])
            yield pd.DataFrame({"k": np.arange(len(out)), "x": out, "lift": lift})

        got = (members.select("n_tokens", "posteriors").mapInPandas(run, "k int, x double, lift double")
               .groupBy("k").agg(F.sum("x"), F.max("lift")).collect())
        x = np.zeros(1 + n_domains + n_domains * n_domains)
        for k, value, _ in got:
            x[k] = value
        x /= total
        return (x[0], max(r[2] for r in got), x[1:1 + n_domains] * scale,
                x[1 + n_domains:].reshape(n_domains, n_domains) * np.outer(scale, scale))

    if not use.any():
        return Rates(scale, np.zeros(n_domains), none_there)
    step, misses = _descend(sums, use, wanted / total, tolerance)
    return Rates(scale, step, np.where(use, misses, none_there))


def _descend(sums, use: np.ndarray, weights: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the steps, and the misses it leaves.

    Steps are gradients of half the squared misses, weighted by the inverse
    curvature of the documents whose rate is positive, which takes out the
    conditioning of rare beside common domains. Rates are projected from the
    sum of all steps, so they end nearest to 1. A step that does not lower
    ``value`` is halved. ``ridge`` keeps the sum finite where no rates meet
    the targets and falls until the misses do not depend on it.
    """
    step, ridge, size, move, slope = np.zeros(len(use)), RIDGE, 1.0, np.zeros(len(use)), 0.0
    value, best = np.inf, (np.inf, step, np.zeros(len(use)))
    for _ in range(MOST_STEPS):
        at = step + size * move
        square, lift, met, curve = sums(at)
        misses = np.where(use, met - 1, 0)
        worst = np.abs(misses).max()
        if worst < best[0]:
            best = (worst, at, misses)
        if worst < tolerance:
            break
        # rates that meet the targets would give at.sum() >= -lift * weights: none do
        settled = at.sum() < -lift * weights[use].sum()
        now = square + at.sum() + ridge * at @ at / 2
        if now > value - 1e-4 * size * slope + 1e-13 * abs(value) and size > 1e-9:
            size /= 2
            continue
        step, value = at, now
        # near the end of this ridge: go on with a smaller one
        while np.abs(misses - ridge * step).max() < max(0.1 * tolerance, 0.01 * worst) and ridge > LEAST_RIDGE:
            ridge /= 100
            value = square + step.sum() + ridge * step @ step / 2
        residual = np.where(use, misses - ridge * step, 0)
        if settled and ridge <= LEAST_RIDGE and np.abs(residual).max() < 0.01 * worst:
            break
        unit = 1 / np.sqrt(np.where(use, np.maximum(np.diag(curve), 0) + ridge, 1))
        e, v = np.linalg.eigh((curve + ridge * np.eye(len(use))) * np.outer(unit, unit))
        move = np.where(use, unit * (v @ ((v.T @ (unit * residual)) / np.maximum(e, 1e-13 * e[-1]))), 0)
        slope, size = residual @ move, 1.0
    return best[1], best[2]


def copies_of(rates: np.ndarray, ids: list) -> np.ndarray:
    """Whole copies: the rate, its fraction rounded by a uniform number drawn from the id's hash."""
    draw = np.array([xxhash.xxh64_intdigest(str(i), 3) / 2.0**64 for i in ids])
    return np.floor(rates + draw).astype(np.int64)


#: tokens per domain, or weights that they shall have
Targets = Mapping[str, float] | Weights


def _reported_rates(members: DataFrame, classifier: Classifier, targets: Targets | None = None) -> Rates:
    """Rates for ``targets``; a missed target, or one of an unknown domain, does not pass in silence."""
    domains = classifier.domains
    if isinstance(targets, Weights):
        rates = solve_rates(members, len(domains), lambda expected: targets.targets(domains, expected))
    elif targets is None:
        rates = solve_rates(members, len(domains))
    else:
        rates = solve_rates(members, len(domains), np.array([targets.get(d, 0.0) for d in domains]))
        unknown = [d for d, t in targets.items() if t > 0 and d not in domains]
        if unknown and rates.scale.any():
            raise ValueError(f"mixing targets for domains without a labelled document: {', '.join(sorted(unknown))}")
    rates.report(domains, targets is not None)
    return rates


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Targets | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, domain, posterior, rate, expected_tokens, copies``.

    ``domain`` is the likeliest one and ``posterior`` its probability.
    ``targets`` gives tokens per domain, or :class:`Weights`; if no rates meet
    them, a ``ValueError`` names the misses (for the default ones, a warning).
    Repeated rows count as often as they stand there and get equal rows; a null id is drawn as the text ``None``;
    extra columns are ignored; an empty table gives an empty result.
    """
    classifier = fit_classifier(docs, labelled)
    members = materialise(membership(docs, classifier), "membership")
    rates, names = _reported_rates(members, classifier, targets), np.array(classifier.domains, object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = np.stack(f["posteriors"].to_numpy()) if len(f) else np.zeros((0, len(names)))
            rate = rates(q)
            ids = [None if pd.isna(i) else int(i) for i in f["doc_id"]]
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": f["n_tokens"],
                                "domain": names[q.argmax(axis=1)], "posterior": q.max(axis=1), "rate": rate,
                                "expected_tokens": rate * f["n_tokens"], "copies": copies_of(rate, ids)})

    return members.mapInPandas(run, "doc_id bigint, n_tokens bigint, domain string, posterior double, rate double, "
                                    "expected_tokens double, copies bigint")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: Targets | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says (all columns, no shuffle of texts); cases as in :func:`mixing_rates`."""
    classifier = fit_classifier(docs, labelled)
    rates = _reported_rates(materialise(membership(docs, classifier), "membership"), classifier, targets)
    text, ident = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rate = rates(classifier.posteriors(part.column(text).to_pylist()))
                n = copies_of(rate, part.column(ident).to_pylist())
                yield part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))

    return docs.mapInArrow(run, docs.schema)
