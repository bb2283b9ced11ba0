"""Quality classifier: importance resampling with hashed n-gram models, sampled by Gumbel top-k.

Texts become counts of hashed unigrams and bigrams. A generative model of the target (labelled good, not toxic) and
one of each other labelled class are counted on the distinct lines of a bounded sample of labelled rows, and rare
buckets left out by the counts of the whole corpus. A class is told from the target by its markers, the buckets that it surely has more of;
all else is one bucket, so that languages and sources of which a class has few rows tell nothing. Raw text is a mixture of the labelled classes' models, by
their shares, and (RAW) of the model of every document, held against that of all labelled ones: text that the corpus has
more of than its labelled rows is not taken for target text. A document's importance is the ratio of its likelihoods under
target and raw text. The k documents of the largest log importance plus Gumbel noise are
selected: a sample without replacement, in proportion to the importance. Texts are scored once; k and the last
score are found in the saved scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, trim, trimmed, unsave
from .select import kth_largest
from .text_hash import ngrams, tokens

LOG_BUCKETS = 18
LABELLED = 20_000  # labelled rows that the models are counted on, at most
PARTS = 16
REPEAT = np.uint64(0x5EED_5EED_5EED_5EED)
RAW = 1e-8  # share of raw text's mixture that the model of the whole corpus has before a text is seen
RARE = 5  # buckets of fewer occurrences in the whole corpus tell nothing
DOUBT = 6.0  # standard errors that a log ratio is pulled towards 0 by
MARKED = 3.0  # the same for the labelled classes' markers


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets, row of each bucket) of each chunk of texts: unigrams, then bigrams."""
    shift = np.uint64(64 - LOG_BUCKETS)
    for i, h, at in tokens(column):
        g, starts = ngrams(h, at, 2)
        again = np.flatnonzero(h[1:] == h[:-1])
        row = np.searchsorted(at, again, side="right") - 1
        inside = again + 1 < at[row + 1]
        g[starts[row[inside]] + again[inside] - at[row[inside]]] = REPEAT  # a word after itself, whichever it is
        rows = np.concatenate([np.repeat(np.arange(len(at) - 1), np.diff(at)), np.repeat(np.arange(len(at) - 1), np.diff(starts))])
        yield i, np.concatenate([h >> shift, g >> shift]).astype(np.int64), rows


SCANNED = "class long, part long, counts binary, hashes binary, sizes binary, buckets binary"
COLUMNS = ["class", "part", "counts", "hashes", "sizes", "buckets"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    c, p, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], COLUMNS)


def _packed(counts: np.ndarray, c: int) -> list[tuple]:
    return [(c, p, zlib.compress(x.tobytes(), 1), None, None, None) for p, x in enumerate(np.split(counts, PARTS)) if x.any()]


def _scan(labels):
    """Bucket counts of the corpus (class 0) and of all labelled rows (the class after the last); of labelled rows, by class, how many there are and their distinct lines.

    Lines go by the hash of the line, so that a line which copies of a text share counts once for a class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, classes, n = labels.value
        corpus, found = np.zeros(1 << LOG_BUCKETS, np.int64), np.zeros(n + 1, np.int64)
        known = np.zeros(1 << LOG_BUCKETS, np.int64)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            own = np.array([x if x is not None else -(2**63) for x in b.column(0).to_pylist()], np.int64)
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            kind = np.where(ids[at] == own, classes[at], 0) if len(ids) else np.zeros(len(own), np.int64)
            found += np.bincount(kind, minlength=n + 1)
            for i, bucket, row in features(b.column(1)):
                corpus += np.bincount(bucket, minlength=len(corpus))
                known += np.bincount(bucket[kind[i + row] > 0], minlength=len(known))
            for c in range(1, n + 1):
                lines, hashes = [], []
                for i in np.flatnonzero(kind == c).tolist():
                    for line in (b.column(1)[i].as_py() or "").split("\n"):
                        if line and (key := (c, xxhash.xxh3_64_intdigest(line))) not in seen:
                            seen.add(key)
                            lines.append(line)
                            hashes.append(key[1])
                if lines:
                    yield _rows(_lines(c, pa.array(lines, pa.string()), np.array(hashes, np.uint64)))
        rows = _packed(corpus, 0) + _packed(known, n + 1) + [(c, PARTS, zlib.compress(found[c : c + 1].tobytes(), 1), None, None, None) for c in range(1, n + 1) if found[c]]
        if rows:
            yield _rows(rows)

    return trimmed(run)


def _lines(c: int, lines: pa.Array, hashes: np.ndarray) -> list[tuple]:
    """Lines packed by shard: their hashes, how many features each has, and the features' buckets."""
    parts = [(bucket, row + i) for i, bucket, row in features(lines)]
    bucket, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    bucket, sizes = bucket[order].astype(np.uint32), np.bincount(row, minlength=len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shard = (hashes % np.uint64(PARTS)).astype(np.int64)
    out = []
    for s in np.unique(shard).tolist():
        at = np.flatnonzero(shard == s)
        out.append((c, s, None, hashes[at].tobytes(), sizes[at].astype(np.uint32).tobytes(), np.concatenate([bucket[starts[k] : starts[k + 1]] for k in at.tolist()]).tobytes()))
    return out


def _distinct(table: pa.Table) -> pa.Table:
    """Bucket counts of a shard's distinct lines."""
    hashes, sizes, buckets = (np.concatenate([np.frombuffer(x, k) for x in table[n].to_pylist()]) for n, k in (("hashes", np.uint64), ("sizes", np.uint32), ("buckets", np.uint32)))
    first = np.zeros(len(hashes), bool)
    first[np.unique(hashes, return_index=True)[1]] = True
    counts = np.bincount(buckets[np.repeat(first, sizes)], minlength=1 << LOG_BUCKETS)
    return pa.Table.from_batches([_rows(_packed(counts, table["class"][0].as_py()) or [(table["class"][0].as_py(), 0, zlib.compress(np.zeros((1 << LOG_BUCKETS) // PARTS, np.int64).tobytes()), None, None, None)])]).select(["class", "part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table["counts"].to_pylist())
    return pa.table({"class": table["class"][:1], "part": table["part"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


class ImportanceModel:
    """Log ratios of the target to each other class by bucket, and the classes' shares (the target first)."""

    def __init__(self, ratios: np.ndarray, shares: np.ndarray, names: list[tuple[int, int]] = ()):
        self.ratios, self.shares, self.names = ratios, shares, list(names)

    def log_classes(self, column: pa.Array) -> np.ndarray:
        """log p(class) + log p(text | class) - log p(text | target) of each text and class."""
        out = np.tile(np.log(self.shares), (len(column), 1))
        if len(self.ratios):
            for i, bucket, row in features(column):
                if len(row):
                    n = int(row.max()) + 1
                    for k, r in enumerate(self.ratios):
                        out[i : i + n, k + 1] -= np.bincount(row, r[bucket], n)
        return out

    def log_weight(self, column: pa.Array) -> np.ndarray:
        """log p(target) - log p(raw) of each text; 0 for texts without tokens."""
        x = self.log_classes(column)
        if not len(x):
            return np.zeros(0)
        top = x.max(1)
        return -(top + np.log(np.exp(x - top[:, None]).sum(1)))


def class_names(model: ImportanceModel) -> list[tuple[int, int]]:
    """(quality, toxic) of each class, the target first."""
    return model.names


def log_ratio(target: np.ndarray, other: np.ndarray, doubt: float = DOUBT) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | other), pulled towards 0 by doubt times its standard error."""
    even = other.sum() / target.sum()  # what a target count comes to in the other class
    ratio = np.log((target + 0.5) * even) - np.log(other + 0.5 * even)
    error = doubt * np.sqrt(1 / (np.maximum(target, other / even) + 0.5) + 1 / (np.maximum(other, target * even) + 0.5))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - error)


def marker_ratio(target: np.ndarray, other: np.ndarray, use: np.ndarray, doubt: float, weak: float = 1.5) -> np.ndarray:
    """log_ratio of the other class's markers: buckets (of those in use) that it has surely more of, by `weak` at least. All else is one bucket.

    Words that tell languages or sources apart, of which classes have unlike shares by chance, so tell nothing of a class.
    """
    ratio = np.where(use, log_ratio(target, other, doubt), 0)
    marks = ratio <= -weak
    return np.where(marks, ratio, np.log((target[~marks].sum() + 0.5) / target.sum()) - np.log((other[~marks].sum() + 0.5) / other.sum()))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, raw: bool = False, doubt: float = DOUBT, markers: bool = False, least: int = 1) -> ImportanceModel:
    """Count the models in one scan of docs. Labels: doc_id, quality, toxic; the target is quality 1 and toxic 0.

    At most `labelled` labelled rows are used, by the order of a hash of their ids; rows with nulls are none. Classes are
    those of which docs have labelled text; without the target or any other there is one class. raw: with a last class,
    of share RAW and without a name, that is counted over every document. doubt: see log_ratio; markers: see marker_ratio (of labelled classes). least:
    classes of fewer labelled rows in docs are left out.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    kinds = {(1, 0): 1} | {k: i + 2 for i, k in enumerate(sorted({(r["q"], r["t"]) for r in some} - {(1, 0)}))}
    some.sort(key=lambda r: r["doc_id"])
    ids, classes = np.array([r["doc_id"] for r in some], np.int64), np.array([kinds[r["q"], r["t"]] for r in some], np.int64)
    nothing = ImportanceModel(np.zeros((0, 1 << LOG_BUCKETS)), np.ones(1), [(1, 0)])
    if len(kinds) < 2:
        return nothing
    shared = docs.sparkSession.sparkContext.broadcast((ids, classes, len(kinds)))
    scanned = save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(shared), SCANNED), "features")
    lines = scanned.where("hashes is not null").groupBy("class", "part").applyInArrow(_distinct, "class long, part long, counts binary")
    rows = scanned.where("counts is not null").select("class", "part", "counts").union(lines).groupBy("class", "part").applyInArrow(_add, "class long, part long, counts binary").collect()
    unsave(scanned)
    counts = np.zeros((len(kinds) + 2, PARTS, (1 << LOG_BUCKETS) // PARTS))
    found = np.zeros(len(kinds) + 1)
    for r in rows:  # a fixed number of buckets for each class
        x = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
        if r["part"] < PARTS:
            counts[r["class"], r["part"]] = x
        else:
            found[r["class"]] = x[0]
    counts = counts.reshape(len(kinds) + 2, -1)
    total = counts.sum(1)
    there = [c for c in range(2, len(kinds) + 1) if total[c] and found[c] >= least]  # classes of which docs have labelled text
    if not total[1] or found[1] < least or not there:
        return nothing
    pairs = [(counts[1], counts[c]) for c in there] + [(counts[-1], counts[0])] * raw
    use = counts[0] >= RARE
    ratios = [marker_ratio(*x, use, doubt) if markers and i < len(there) else np.where(use, log_ratio(*x, DOUBT if i == len(there) else doubt), 0) for i, x in enumerate(pairs)]
    shares, names = found[[1, *there]], sorted(kinds, key=kinds.get)
    shares = shares / shares.sum()
    return ImportanceModel(np.array(ratios), np.append(shares * (1 - RAW), RAW) if raw else shares, [names[c - 1] for c in (1, *there)])


def _noise(seed: int):
    """Gumbel noise that a document's id decides."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _scored(docs: DataFrame, model: ImportanceModel, temperature: float, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pa.Array) -> pa.Array:
        out = pa.array(shared.value.log_weight(text))
        trim()
        return out

    weight = F.arrow_udf(run, "double")
    return docs.withColumn("log_weight", weight("text")).withColumn("score", F.col("log_weight") + _noise(seed) * temperature)


def scored(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, seed: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of docs with log_weight, score and selected (see select), out of one pass over the texts."""
    model = fit(docs, labels, raw=True, doubt=MARKED, markers=True)
    rest = [c for c in carry if c not in ("log_weight", "score", "selected")]
    need = [c for c in docs.columns if c in {*rest, "doc_id", "text"}]
    rows = save(_scored(docs.select(*need), model, temperature, seed).select(*rest, "log_weight", "score"), "scores")
    if not len(model.ratios) and share is None:
        return rows.withColumn("selected", F.lit(True))
    edge = float(np.log(0.5 / (model.shares[0] / (1 - RAW))))  # of a posterior of 1/2
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= edge).alias("k")).first()
    k = facts["k"] if share is None else round(share * facts["n"])
    floor = kth_largest(rows, "score", k) if k else float("inf")
    return rows.withColumn("selected", F.col("score") >= F.lit(floor if floor is not None else float("-inf")))


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = 1.0, seed: int = 3) -> DataFrame:
    """docs' columns with log_weight, score and selected (columns of these names are replaced).

    k is round(share * rows), or, by default, the number of rows that the models take for target text: those of a
    posterior of 1/2 or more. The k rows of the largest score are selected, with those that tie with the last. Noise
    depends on doc_id and seed alone, so rows that repeat an id get one noise; a null id has its own. A temperature below
    1 sharpens the importance. Null and empty texts have log_weight 0. Without labels of the target and of another class
    all weights are 0 and, without a share, every row is selected.
    """
    return scored(docs, labels, share, temperature, seed, tuple(docs.columns))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, score and selected of every document; null and empty texts weigh as much as target text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
