"""Mixing sources to target weights by soft membership.

A classifier of hashed n-grams, fitted on a labelled table, gives each document's posteriors over domains. Document
rates r >= 0 are fitted by projected gradient least squares so that the expected token totals of the domains,
sum_i r_i tokens_i p_id, meet their targets:

    r_i <- max(0, r_i - p_i . M (A r - T)),   M the inverse of sum_i tokens_i p_i p_i' over rates above 0

which is gradient descent on the residual's M-norm at the step 1 / L (L = 1 in this norm, rates weighed by tokens),
projected on r >= 0; with M over all documents the residual never grows, so a round that doesn't shrink it is taken
again with that. A round needs the residual of D domains only: the driver keeps their history, and every task
replays it for its rows. So no rate is shuffled or stored, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, save, trim, trimmed
from .quality import LABELLED, ImportanceModel, class_names, fit
from .text_hash import tokens

ROUNDS = 40
CLOSE = 1e-7
DOUBT = 2.0  # standard errors that a log ratio of two classes is pulled towards 0 by
LEAST = 20  # labelled rows that a class needs to be a domain


class DomainModel:
    """Posteriors over the classes of a fitted model, in the order of its classes."""

    def __init__(self, model: ImportanceModel):
        self.model, self.domains = model, max(1, len(model.shares))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and posteriors of each text."""
        size = np.zeros(len(column), np.int64)
        for i, _, at in tokens(column):
            size[i : i + len(at) - 1] = np.diff(at)
        logs = self.model.log_classes(column)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return size, p / p.sum(1, keepdims=True)


def rates(p: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Every row's rate after the rounds of history (one row of M (A r - T) each), from 1."""
    r = np.ones(len(p))
    for step in history:
        r = np.maximum(0, r - p @ step)
    return r


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(d: int, history: np.ndarray):
    """A task's part of sum_i tokens_i p_i p_i' over rates above 0, and of A r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d * d + d)
        for b in batches:
            t, p = b.column(0).to_numpy().astype(float), _matrix(b.column(1), d)
            r = rates(p, history)
            on = p * (t * (r > 0))[:, None]
            out += np.concatenate([(p.T @ on).ravel(), (t * r) @ p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "x"])

    return trimmed(run)


def _sum(df: DataFrame, d: int, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("tokens", "posterior").mapInArrow(_totals(d, np.array(history).reshape(-1, d)), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(d * d + d)
    for r in rows:  # a few sums of D domains
        out[r["i"]] = r["x"]
    return out[: d * d].reshape(d, d), out[d * d :]


def solve(members: DataFrame, d: int, weights: np.ndarray, total: float | None = None, at_most: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The history of steps, the targets, and the totals that the rates come to. total: of tokens; by default what leaves the first domain's as they are.

    The two differ where no rates meet the targets, and where ROUNDS rounds weren't enough. The rounds after the one that came
    nearest are left out: where few rows can't meet the targets, they raise rates without end.

    at_most: weights of domains after the first are bounds; one that has less keeps its share, and the first
    domain has the rest.
    """
    gram, now = _sum(members, d, [])
    weights = np.asarray(weights, float) / max(1e-300, float(np.sum(weights)))
    if at_most and now.sum() > 0:
        weights = np.minimum(weights, now / now.sum())
        weights[0] = 1 - weights[1:].sum()
    if total is None:
        total = float(now[0] / weights[0]) if weights[0] > 0 else float(now.sum())
    target = weights * total
    inverse = lambda g: np.linalg.pinv(g, rcond=1e-12, hermitian=True)
    whole = inverse(gram)
    size = lambda x: float((x - target) @ whole @ (x - target))
    far = lambda x: float(np.abs(x - target).max())
    history, got, best = [], now, (far(now), 0, now)
    for _ in range(ROUNDS):
        if far(got) <= CLOSE * max(1.0, target.sum()):
            break
        step = inverse(gram) @ (got - target)
        new_gram, new = _sum(members, d, [*history, step])
        if size(new) >= size(got):
            step = whole @ (got - target)
            new_gram, new = _sum(members, d, [*history, step])
        history.append(step)
        gram, got = new_gram, new
        best = min(best, (far(got), len(history), got), key=lambda x: x[0])
    return np.array(history[: best[1]]).reshape(-1, d), target, best[2]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[tuple[int, int], float], total: float | None = None, at_most: bool = False, seed: int = 4, carry: tuple[str, ...] | None = None, known: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """docs' columns (those of carry, if given) with tokens, posterior, rate, copies and unmet (columns of these names are replaced).

    Domains are the labelled classes (quality, toxic); weights are the shares of tokens that they are to have (a
    class without one gets 0; those of classes without labelled text are dealt over the rest), or at most, if at_most (see
    solve). rate >= 0 is a document's expected number of copies, copies the rate rounded down or up by a draw that
    doc_id and seed decide: rows that repeat an id share a draw. unmet is the largest distance of a domain's expected tokens
    from their target, as a share of all tokens wanted: 0 where the rates meet the targets. Null and empty texts have no tokens, the classes'
    shares as posteriors and the rate 1, as no total depends on theirs. Without labelled classes there is one domain and every rate is 1.
    The classes are counted on the labelled rows of `known` (doc_id, text; docs by default), of which the model sees at most
    LABELLED: where docs were filtered before, known is the table before that, since what a filter leaves of a class is
    not like the class. A class of fewer than `least` labelled rows there is no domain, and without two classes there is one domain.
    A class is known by its markers alone (see quality.marker_ratio). Posteriors and totals cover every row of docs. Texts are read once by the
    model; rows with their posteriors are written, and only tokens and posteriors read again for each round.
    """
    spark = docs.sparkSession
    model = fit(docs if known is None else known, labels, LABELLED, doubt=DOUBT, markers=True, least=least)
    d = max(1, len(model.shares))
    names = class_names(model)
    shared = spark.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        size, p = DomainModel(shared.value)(text)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
        trim()
        return pa.StructArray.from_arrays([pa.array(size), flat], ["tokens", "posterior"])

    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("tokens", "posterior", "rate", "copies", "unmet")]
    member, key = fresh("member", docs.columns), fresh("key", docs.columns)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    read = docs.withColumn(member, F.arrow_udf(run, "tokens long, posterior array<double>")("text")).withColumn(key, draw)
    members = save(read.select(*kept, key, f"{member}.tokens", f"{member}.posterior"), "posteriors")
    history, target, got = solve(members, d, np.array([weights.get(n, 0.0) for n in names]) if len(names) else np.ones(1), total, at_most)
    rule = spark.sparkContext.broadcast(history)
    rate = F.arrow_udf(lambda p: pa.array(rates(_matrix(p, d), rule.value)), "double")
    copies = (F.floor("rate") + (F.col(key) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    unmet = F.lit(float(np.abs(got - target).max() / max(1.0, target.sum())))
    return members.withColumn("rate", F.when(F.col("tokens") > 0, rate("posterior")).otherwise(F.lit(1.0))).withColumn("copies", copies).drop(key).withColumn("unmet", unmet)


#: What the classes (quality, toxic) are to have of the mix, and what they may have at most after a quality filter.
WEIGHTS = {(1, 0): 0.94, (0, 0): 0.03, (1, 1): 0.02, (0, 1): 0.01}
AFTER_FILTER = {(1, 0): 0.994, (0, 0): 0.002, (1, 1): 0.002, (0, 1): 0.002}


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies and unmet of every document; null and empty texts have no tokens and the rate 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS, carry=("doc_id",))
