"""Mixing to target weights with soft domain membership.

A softmax classifier fitted on labelled rows gives every document a posterior over domains. A
document of ``t`` tokens taken at rate ``r`` then adds ``r * t * posterior`` to the expected tokens
of each domain. Nonnegative rates are sought whose totals come closest to the targets, by projected
gradient descent on the squared gaps. The gradient of a document's rate is its posterior times the
gaps, so all steps together move it by its posterior times one vector, a number per domain; then the
rate is projected: below zero it becomes zero. Steps are scaled by how the totals answer to them (the
Gram matrix of posteriors over documents with a positive rate). A step needs a few sums over all
documents, and rates follow from the vector as a column expression; none is stored or moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiflow.llm.features import SURFACE, Flat, dense, hashed_words
from lexiflow.llm.store import free_names, materialize, slices

#: Domains of the labels table: by toxicity first, then by quality.
DOMAINS = ("good", "poor", "toxic")
#: Shares of tokens that are aimed at.
TARGETS = {"good": 0.95, "poor": 0.045, "toxic": 0.005}
#: At most so many labelled rows are fitted on, a third from each domain: those with the smallest hash of their id.
SAMPLE = 6000
BINS = 1 << 16
#: Steps end when the gradient is this share of the targets; many fewer than so many are needed.
TOLERANCE, STEPS = 1e-7, 100
#: Weight of the squared distance of rates from their start, beside the squared gaps: of rates that do equally well, the nearest.
RIDGE = 1e-8


@dataclass(frozen=True)
class DomainModel:
    """Softmax over surface shares and hashed words."""

    mean: np.ndarray
    scale: np.ndarray
    surface: np.ndarray
    words: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: Sequence[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, len(self.bias)))
        flat = Flat(texts)
        z = np.clip((dense(texts, False, flat) - self.mean) / self.scale, -6, 6).astype(np.float64) @ self.surface + self.bias
        row, column, value = hashed_words(texts, BINS, flat)
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(row, self.words[column, k] * value, minlength=len(texts))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit_domains(x: np.ndarray, bins: Sequence[np.ndarray], domain: np.ndarray, n_domains: int, steps: int = 120, rate: float = 0.15, decay: float = 1e-5) -> DomainModel:
    """Cross-entropy by full-batch Adam from zero weights, on surface shares ``x`` and the bins of each row's words. Without rows, all domains are equally likely."""
    n, n_surface = len(x), len(SURFACE)
    if not n:
        return DomainModel(np.zeros(n_surface), np.ones(n_surface), np.zeros((n_surface, n_domains)), np.zeros((BINS, n_domains)), np.zeros(n_domains))
    sizes = np.array([len(b) for b in bins], np.int64)
    row, column = np.repeat(np.arange(n), sizes), np.concatenate(bins).astype(np.int64)
    value = (4.0 / np.sqrt(np.maximum(sizes, 1)))[row]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    truth = np.eye(n_domains)[domain]
    w = [np.zeros((k, n_domains)) for k in (n_surface, BINS, 1)]
    w[2][0] = np.log((truth.sum(axis=0) + 1) / (n + n_domains))
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        z = x @ w[0] + w[2]
        for k in range(n_domains):
            z[:, k] += np.bincount(row, w[1][column, k] * value, minlength=n)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - truth) / n
        words = np.stack([np.bincount(column, g[row, k] * value, minlength=BINS) for k in range(n_domains)], axis=1)
        for j, grad in enumerate((x.T @ g + decay * w[0], words + decay * w[1], g.sum(axis=0, keepdims=True))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad * grad
            w[j] = w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return DomainModel(mean, scale, w[0], w[1] * 4, w[2][0])


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def _encoded(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        texts = _encoded(batch.column("text").to_pylist())
        flat = Flat(texts)
        x = dense(texts, False, flat)
        row, column, _ = hashed_words(texts, BINS, flat)
        bins = np.split(column.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("domain"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([b.tobytes() for b in bins], pa.binary())], ["id", "domain", "x", "bins"])


def train_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DomainModel:
    """Fit on at most ``sample`` labelled rows, a third at most of each domain of ``labels`` (columns quality and toxic).

    Rows with a null label or id are left out; an id with several labels has its largest, and an id
    with several texts counts with its least. Features are made where texts are, so the driver gets
    numbers only: some bytes for each distinct word of a fitted row.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").dropna().groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = materialize(marked.select("id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")), "marked")
    chosen = [(r.id, r.domain) for d in range(len(DOMAINS)) for r in marked.filter(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(sample // len(DOMAINS)).collect()]
    counts = {r.domain: r["count"] for r in marked.groupBy("domain").count().collect()}
    rows = []
    if chosen:
        picked = F.broadcast(spark.createDataFrame(chosen, "id long, domain int"))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id").groupBy("id", "domain").agg(F.min("text").alias("text"))
        rows = sorted(texts.mapInArrow(_features, "id long, domain int, x binary, bins binary").collect(), key=lambda r: r.id)
    domain = np.array([r.domain for r in rows], int)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), len(SURFACE))
    model = fit_domains(x, [np.frombuffer(r.bins, np.int32) for r in rows], domain, len(DOMAINS))
    # The sample is even over domains; the table is not.
    taken = np.bincount(domain, minlength=len(DOMAINS)) + 1.0
    every = np.array([counts.get(d, 0) for d in range(len(DOMAINS))]) + 1.0
    return DomainModel(model.mean, model.scale, model.surface, model.words, model.bias + np.log(every / every.sum()) - np.log(taken / taken.sum()))


@dataclass(frozen=True)
class Mixture:
    """Rates that were found: the moves by domain, and expected tokens by domain, aimed at and reached."""

    move: tuple[float, ...]
    start: float
    target: np.ndarray
    reached: np.ndarray

    @property
    def gap(self) -> float:
        """What is left of the targets, as a share of them."""
        return float(np.abs(self.target - self.reached).sum() / max(self.target.sum(), 1e-300))

    def rate(self, names: Sequence[str]) -> Column:
        """The rate of a row whose posteriors are in the columns ``names``."""
        return _rate(self.move, self.start, names)


def _rate(move: Sequence[float], start: float, names: Sequence[str]) -> Column:
    moved = F.lit(float(start))
    for name, m in zip(names, move, strict=True):
        moved = moved + F.col(name) * F.lit(float(m))
    return F.greatest(F.lit(0.0), moved)


def fit_rates(described: DataFrame, targets: Sequence[float], budget: float = 1.0, tokens: str = "n_tokens", names: Sequence[str] | None = None, ridge: float = RIDGE, tolerance: float = TOLERANCE, steps: int = STEPS) -> Mixture:
    """Projected-gradient least squares on the gaps between expected and target tokens by domain.

    ``described`` has ``tokens`` and the posteriors ``names`` (p0, p1, ... unless given); targets are
    shares of ``budget`` times all tokens. A step that goes too far is halved. Where no nonnegative
    rates close the gaps, it ends at the least squares, and ``gap`` says what is left. Without tokens
    the rates stay at their start.
    """
    n = len(targets)
    names = list(names or (f"p{k}" for k in range(n)))
    pairs = [(j, k) for j in range(n) for k in range(j, n)]

    def sums(move: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Expected tokens by domain, their answer to a move, half the squared rates, and all tokens."""
        t, rate = F.col("t"), F.col("rate")
        rows = described.select(F.col(tokens).cast("double").alias("t"), *names, _rate(move, budget, names).alias("rate"))
        wanted = [F.sum(rate * t * F.col(c)) for c in names] + [F.sum(F.when(rate > 0, t * F.col(names[j]) * F.col(names[k])).otherwise(0.0)) for j, k in pairs] + [F.sum(rate * rate * t), F.sum("t")]
        row = np.array(rows.agg(*(F.coalesce(s, F.lit(0.0)).alias(f"s{k}") for k, s in enumerate(wanted))).first(), float)
        gram = np.zeros((n, n))
        for (j, k), value in zip(pairs, row[n:-2], strict=True):
            gram[j, k] = gram[k, j] = value
        return row[:n], gram, row[-2] / 2, row[-1]

    move = np.zeros(n)
    now, gram, half, every = sums(move)
    target = np.asarray(targets, float) / sum(targets) * budget * every
    aim, scale = target / max(every, 1e-300), max(every, 1e-300)
    value = lambda half, move: half / scale - aim @ move + ridge / 2 * move @ move
    left = steps if every else 0
    while left > 0:
        slope = now / scale - aim + ridge * move
        if np.abs(slope).sum() <= tolerance * aim.sum():
            break
        step = -np.linalg.solve(gram / scale + ridge * np.eye(n), slope)
        length, before = 1.0, value(half, move)
        while True:
            left -= 1
            trial = move + length * step
            got = sums(trial)
            if value(got[2], trial) <= before + 1e-4 * length * (slope @ step) or left <= 0 or length < 1e-9:
                break
            length /= 2
        if value(got[2], trial) >= before:
            break
        move, (now, gram, half, _) = trial, got
    return Mixture(tuple(move.tolist()), budget, target, now)


def described_documents(docs: DataFrame, model: DomainModel, id_col: str, text_col: str, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` stored with its columns ``keep`` and, under names it does not use (given back), a hash of id and text, its words, and its posteriors."""
    names = free_names(docs.columns, "row_hash", "n_tokens", *(f"p{k}" for k in range(len(DOMAINS))), "whole_text")
    *added, whole = names
    text = F.col(text_col).cast("string")
    marked = docs.select(*keep, F.xxhash64(F.col(id_col).cast("long"), text).alias(added[0]), text.alias(whole))
    schema = StructType(list(docs.select(*keep).schema.fields)).add(added[0], "long").add(added[1], "long")
    for name in added[2:]:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, whole, 1 << 19):
            texts = _encoded(batch.column(whole).to_pylist())
            p = model.posteriors(texts)
            n = np.array([len(t.split()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), *(pa.array(c) for c in p.T)], [*keep, *added])

    return materialize(marked.mapInArrow(run, schema), "described"), added


def _plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, id_col: str, text_col: str, budget: float, keep: Sequence[str]) -> tuple[Mixture, DataFrame, list[str]]:
    """Rates for each domain, the described documents, and the names of what was added to them."""
    aims = targets or TARGETS
    groups = [[DOMAINS.index(d) for d in key.split("+")] for key in aims]
    if sorted(k for g in groups for k in g) != list(range(len(DOMAINS))):
        raise ValueError(f"targets must name each of {', '.join(DOMAINS)} once")
    model = train_domains(docs, labels, id_col, text_col)
    described, added = described_documents(docs, model, id_col, text_col, keep)
    p = added[2:]
    sums = [sum((F.col(p[k]) for k in g[1:]), F.col(p[g[0]])).alias(f"p{j}") for j, g in enumerate(groups)]
    found = fit_rates(described.select(F.col(added[1]).alias("n_tokens"), *sums), list(aims.values()), budget)
    move = tuple(next(m for m, g in zip(found.move, groups, strict=True) if k in g) for k in range(len(DOMAINS)))
    return replace(found, move=move), described, added


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """One row per input row: ``id_col``, rid, n_tokens (words), p_<domain>, rate, copies, gap.

    copies is the rate with its fraction rounded up for a share of documents that a hash of id
    and text picks, so copies are whole and their expected tokens are those of the rates. gap is
    what is left between expected and target tokens of the whole table, as a share of the targets:
    the same in every row, and about zero wherever nonnegative rates can reach them. A null or empty
    text has no tokens and the posterior of an empty text. rid is that hash. Repeated rows get equal
    rates; an empty table gives no rows; other columns are not looked at.

    ``targets`` names each domain once. Domains joined by a plus, as in ``good+poor``, share one aim,
    and their posteriors count as one. An aim below what clean text holds of a domain by faint
    posteriors can only be reached by leaving clean text out.
    """
    found, described, (rid, tokens, *p) = _plan(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), labels, targets, id_col, text_col, budget, [id_col])
    rate = found.rate(p)
    return described.select(
        id_col, F.col(rid).alias("rid"), F.col(tokens).alias("n_tokens"), *(F.col(c).alias(f"p_{d}") for c, d in zip(p, DOMAINS, strict=True)), rate.alias("rate"), copies(rate, F.col(rid)).alias("copies"), F.lit(found.gap).alias("gap")
    )


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as :func:`mix` says.

    Rows are stored with their posteriors, so each text is read by the classifier once and is not shuffled.
    """
    found, described, (rid, _, *p) = _plan(docs, labels, targets, id_col, text_col, budget, docs.columns)
    times = copies(found.rate(p), F.col(rid)).cast("int")
    (copy,) = free_names(docs.columns, "copy")
    return described.filter(times > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)


def copies(rate: Column, rid: Column) -> Column:
    """Whole copies for a rate: the fraction decides by a uniform hash."""
    uniform = F.pmod(F.xxhash64(rid, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + uniform)
