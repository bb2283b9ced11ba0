"""Suffix-array dedup: repeated byte strings of a fixed length are found among sorted suffixes.

A corpus has a suffix for every byte; sorting them all would ship a string for every byte. Two equal strings of
`length` bytes hold the same least k-byte gram at the same place, so the suffixes that begin at these grams
(about one byte in 35) are enough to find every repeat, and each stands for the run of windows that it anchors:

1.  Every scan task takes its texts' anchored suffixes. Splitters, sampled from the corpus, range-partition them by
    their leading bytes (and by content, where one leading key is frequent enough to hold several splitters).
2.  A bucket sorts its suffixes by multikey quicksort: leading bytes, the rest of the gram, the whole run's content,
    place. Neighbours of one content repeat; all but the first place go. A gram with several contents - also one that
    a splitter may have cut, so that its neighbours lie across the boundary - is left open.
3.  For open grams the runs are compared window by window, again sorted, and all but the first place go.

Equal contents within a slice of a task's texts are settled there, before anything is shuffled, so copies of one text
load no bucket: the first is shipped, and the spans of the rest go with it.
Comparisons are of 64-bit hashes of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom
from .common import blocks_for, mix64, numbered, save, size_in_bytes, trim, trimmed
from .text_hash import _power, chunks, texts_of

GRAM = 32
_BYTES = np.random.default_rng(9).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def multikey_order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns, first to last; a later column is looked at only within runs that tie so far."""
    order = np.argsort(columns[0], kind="stable")
    tied = np.arange(len(order))
    run = np.zeros(len(order), np.int64)
    for before, column in zip(columns[:-1], columns[1:], strict=True):
        v = before[order[tied]]
        same = np.zeros(len(tied), bool)
        same[1:] = (v[1:] == v[:-1]) & (run[1:] == run[:-1]) & (np.diff(tied) == 1)
        in_run = same.copy()
        in_run[:-1] |= same[1:]
        group = np.cumsum(~same)
        tied, run = tied[in_run], group[in_run]
        if not len(tied):
            break
        order[tied] = order[tied][np.lexsort((column[order[tied]], run))]
    return order


class Runs:
    """The anchored runs of windows of a chunk of texts."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, length: int):
        n = len(raw)
        k = min(GRAM, max(1, length // 3))
        self.key = self.content = np.zeros(0, np.uint64)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        size = np.diff(edges)
        if not (size >= length).any():
            return
        power, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[:n], out=sums[1:])
        gram = mix64((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
        self.window = mix64((sums[length:] - sums[:-length]) * inverse[: n - length + 1], 1)
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        w, span = length - k + 1, 1
        while span * 2 <= w:  # sliding minimum by doubling
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        ok = np.zeros(n + 1, np.int64)
        long = size >= length
        np.add.at(ok, edges[:-1][long], 1)
        np.add.at(ok, edges[1:][long] - length + 1, -1)
        p = np.flatnonzero(np.cumsum(ok)[: n - length + 1] > 0)
        anchor = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
        stop = np.append(start[1:], len(p)) - 1
        self.first, self.last, a = p[start], p[stop], anchor[start]
        self.doc = np.searchsorted(edges, self.first, side="right") - 1
        lead = np.zeros(len(a), np.uint64)
        for i in range(min(4, k)):
            lead = (lead << np.uint64(8)) | raw[a + i]
        self.key = (lead << np.uint64(32)) | (gram[a] & np.uint64(0xFFFFFFFF))  # leading bytes first
        self.content = mix64(self.window[self.first] ^ mix64(self.window[self.last] + (self.last - self.first).astype(np.uint64), 2), 3)


def firsts(*columns: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in sorted order, and which of them begin a class of equal leading `by` columns."""
    order = multikey_order(*columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns[:by]:
        v = c[order]
        new[1:] |= v[1:] != v[:-1]
    return order, new


def _batch(batch: pa.RecordBatch, length: int):
    """(key, content, document, start, windows - 1, hash of windows or None) of a batch's runs, by chunk."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, data = texts_of(batch.column(1))
    for i, j in chunks(at):
        runs = Runs(data[at[i] : at[j]], at[i : j + 1] - at[i], length)
        if len(runs.key):
            yield runs, ids[i:j][runs.doc], (runs.first - (at[i : j + 1] - at[i])[runs.doc])


def _packed(kind: str, block: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of columns, one packed row for each block."""
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    rows = [(kind, int(block[a]), *(c[a:b].tobytes() for c in columns)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    if rows:
        v = list(zip(*rows, strict=True))
        none = [pa.nulls(len(rows), pa.binary())] * (5 - len(columns))
        yield pa.RecordBatch.from_arrays([pa.array(v[0], pa.string()), pa.array(v[1], pa.int64()), *(pa.array(x, pa.binary()) for x in v[2:]), *none], NAMES)


NAMES = ["kind", "block", "c0", "c1", "c2", "c3", "c4"]
PACKED = "kind string, block long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"


def _gathered(table: pa.Table, *kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, k) for x in table[f"c{i}"].to_pylist()]) if table.num_rows else np.zeros(0, k) for i, k in enumerate(kinds)]


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for runs, _, _ in _batch(b, length):
                some = mix64(runs.content, 4) % np.uint64(8) == 0
                yield pa.RecordBatch.from_arrays([pa.array(runs.key[some].view(np.int64)), pa.array(runs.content[some].view(np.int64))], ["key", "content"])

    return trimmed(run)


def bucket_of(key: np.ndarray, content: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many splitters (key, content) are not above each row."""
    keys, contents = at
    low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
    out = low.copy()
    for k in np.unique(key[low < high]):
        rows = np.flatnonzero(key == k)
        a, b = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
        out[rows] = a + np.searchsorted(contents[a:b], content[rows], side="right")
    return out


SLICE = 12 << 20


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of `most` bytes of text each (or one text), which bounds what a task holds."""
    for b in batches:
        for i, j in chunks(texts_of(b.column(1))[0], most):
            yield b.slice(i, j - i)
            trim()


def _suffixes(length: int, shards: int, splitters, most: int):
    """The first run of each content of a slice, by bucket, and the spans of the other runs, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = splitters.value
        for b in _slices(batches, most):
            parts = [(r.key, r.content, d, s, r.last - r.first) for r, d, s in _batch(b, length)]
            if not parts:
                continue
            key, content, doc, start, more = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, new = firsts(key, content, doc, start, by=2)
            again = order[~new]
            yield from _spans(doc[again], start[again], start[again] + more[again] + length, shards)
            keep = np.sort(order[new])  # in the order of places, which packs best
            key, content, doc, start, more = key[keep], content[keep], doc[keep], start[keep], more[keep]
            yield from _packed("suffix", bucket_of(key, content, at), key, content, doc, start.astype(np.uint32), more.astype(np.uint16))

    return trimmed(run)


def _sort_bucket(length: int, shards: int, splitters):
    def run(table: pa.Table) -> pa.Table:
        spans = pc.equal(table["kind"], "span")
        passed, block = table.filter(spans), table["block"][0].as_py()
        key, content, doc, start, more = _gathered(table.filter(pc.invert(spans)), np.uint64, np.uint64, np.int64, np.uint32, np.uint16)
        order, new = firsts(key, content, doc, start, by=2)
        key, doc, start, more = key[order], doc[order], start[order].astype(np.int64), more[order].astype(np.int64)
        # grams with several contents, and those that a boundary may cut
        class_key = key[new]
        several = class_key[1:][class_key[1:] == class_key[:-1]]
        cut = np.intersect1d(class_key, splitters.value[0])
        out = passed.cast(SCHEMA).to_batches() + list(_spans(doc[~new], start[~new], start[~new] + more[~new] + length, shards))
        left_open = np.unique(np.concatenate([several, cut]))
        out += list(_packed("open", np.full(len(left_open), block), left_open))
        trim()
        return pa.Table.from_batches(out, SCHEMA) if out else SCHEMA.empty_table()

    return run


SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), *((f"c{i}", pa.binary()) for i in range(5))])


def _spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove, overlaps united, packed by the shard of their document."""
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, stop = doc[order], start[order], stop[order]
        doc, start, stop = united(doc, start, stop)
        yield from _packed("span", (mix64(doc.view(np.uint64), 12) % np.uint64(shards)).astype(np.int64), doc, start.astype(np.uint32), stop.astype(np.uint32))


def united(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of spans that are sorted by document and start."""
    if not len(doc):
        return doc, start, stop
    _, at = np.unique(doc, return_index=True)
    rank = np.zeros(len(doc), np.int64)
    rank[at[1:]] = 1
    rank = np.cumsum(rank)
    shift = rank * (int(stop.max()) + 2)  # documents side by side, apart from each other
    far = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > far[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], far[last] - shift[last]


def _open_windows(length: int, blocks: int, shards: int, wanted, most: int):
    """The windows of open grams, and the spans of those that repeat within a slice.

    Runs that repeat whole within the slice are left out: they went with _suffixes or its buckets, whatever the slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bloom(wanted.value)
        for b in _slices(batches, most):
            parts = []
            for r, d, s in _batch(b, length):
                hit = bits.has(r.key)  # only these runs' windows are kept
                parts.append((r.key, r.content, d, s, r.last - r.first, hit, r.window[_ranges(r.first[hit], r.last[hit])]))
            if not parts:
                continue
            key, content, doc, start, more, hit, windows = (np.concatenate([p[i] for p in parts]) for i in range(7))
            del parts
            at = np.cumsum(np.where(hit, more + 1, 0)) - np.where(hit, more + 1, 0)
            order, new = firsts(key, content, doc, start, by=2)
            again = np.zeros(len(key), bool)
            again[order[~new]] = True
            todo = np.flatnonzero(~again & hit)
            todo = todo[np.lexsort((start[todo], doc[todo]))]  # in the order of places, which a stable sort of hashes keeps
            h = windows[_ranges(at[todo], at[todo] + more[todo])]
            del windows
            run_of = np.repeat(np.arange(len(todo), dtype=np.uint32), more[todo] + 1)
            offset = _ranges(np.zeros(len(todo), np.int64), more[todo]).astype(np.uint16)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            first, rest = order[new], order[~new]
            h = h[new]
            place = lambda i: (doc[todo[run_of[i]]], start[todo[run_of[i]]] + offset[i])  # noqa: E731, B023
            d, s = place(first)
            yield from _packed("window", (mix64(h, 13) % np.uint64(blocks)).astype(np.int64), h, d, s.astype(np.uint32))
            del h, d, s, order, first
            d, s = place(rest)
            for x in _spans(d, s, s + length, shards):
                # spans pass through the windows' tasks, each packed row by its shard
                yield x.set_column(1, "block", pa.array(x.column(1).to_numpy() % blocks, pa.int64())).set_column(6, "c4", pa.array([int(v).to_bytes(8, "little") for v in x.column(1).to_pylist()], pa.binary()))

    return trimmed(run)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[i], ..., last[i] for each i."""
    n = last - first + 1
    if not len(n):
        return np.zeros(0, np.int64)
    return np.arange(n.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _sort_windows(length: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table["kind"].to_pylist())
        h, d, s = _gathered(table.filter(pa.array(kind == "window")), np.uint64, np.int64, np.uint32)
        order, new = firsts(h, d, s, by=1)
        d, s = d[order][~new], s[order][~new].astype(np.int64)
        out = list(_spans(d, s, s + length, shards))
        rest = table.filter(pa.array(kind == "span"))
        if rest.num_rows:
            shard = pa.array([int.from_bytes(x, "little") for x in rest["c4"].to_pylist()], pa.int64())
            out += rest.set_column(1, "block", shard).set_column(6, "c4", pa.nulls(rest.num_rows, pa.binary())).cast(SCHEMA).to_batches()
        trim()
        return pa.Table.from_batches([x.cast(SCHEMA) for x in out], SCHEMA) if out else SCHEMA.empty_table()

    return run


def _by_document(table: pa.Table) -> pa.Table:
    doc, start, stop = _gathered(table, np.int64, np.uint32, np.uint32)
    order = np.lexsort((start, doc))
    doc, start, stop = united(doc[order], start[order].astype(np.int64), stop[order].astype(np.int64))
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, int)
    pairs = np.stack([start, stop], 1)
    return pa.table({"doc": pa.array(doc[cut[:-1]], pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    size, gone, runs, kept = [], [], [], []
    for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        own = np.frombuffer(cut or b"", np.int64).reshape(-1, 2).tolist()
        at, left = 0, []
        for a, b in own:
            left.append(raw[at:a])
            at = b
        left.append(raw[at:])
        size.append(len(raw))
        gone.append(sum(b - a for a, b in own))
        runs.append([{"start": a, "stop": b} for a, b in own])
        kept.append(b"".join(left))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    trim()
    return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "spans", "kept"])


def dedup_substrings(docs: DataFrame, length: int = 100, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, stop in bytes) and kept (binary) of each row of docs.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Strings are judged on the input and never cross documents. Texts are taken as UTF-8; null
    is empty. Rows that repeat a doc_id, and those without one (first), are documents in the order of their texts.
    Other columns of docs are left alone and not returned. slice_bytes bounds the text that a task looks at at once
    and doesn't change the result.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    spark = docs.sparkSession
    sc = spark.sparkContext
    own = numbered(docs.select("doc_id", "text"), "__id")
    texts = own.select("__id", "text")
    # buckets of 8 MiB of text; above 32 GB larger ones, up to 64 MiB, which is some 60 MB of runs
    blocks = blocks_for(docs, (8 << 20) * min(8, max(1, size_in_bytes(docs) >> 35)), least=16)

    # splitters: 64 KiB of text for each bucket are looked at, a few runs of each come to the driver
    share = max(1, size_in_bytes(docs) // (blocks * (64 << 10)))
    seen = texts.where(F.pmod(F.xxhash64("__id"), F.lit(share)) == 0).mapInArrow(_sample(length), "key long, content long")
    seen = seen.orderBy(F.xxhash64("content")).limit(max(100_000, 16 * blocks)).toArrow()
    k, c = (seen[x].to_numpy().astype(np.int64).view(np.uint64) for x in ("key", "content"))
    order = multikey_order(k, c)
    at = order[np.unique(np.linspace(0, len(order), blocks + 1).astype(int)[1:-1].clip(0, max(0, len(order) - 1)))] if len(order) else order
    splitters = sc.broadcast((k[at], c[at]))  # one for each bucket

    found = save(texts.mapInArrow(_suffixes(length, blocks, splitters, slice_bytes), PACKED).groupBy("block").applyInArrow(_sort_bucket(length, blocks, splitters), PACKED), "suffixes")
    open_ = found.where("kind = 'open'").select("c0").mapInArrow(_longs, "key long")
    wanted = sc.broadcast(bloom(open_, 26))
    more = texts.mapInArrow(_open_windows(length, blocks, blocks, wanted, slice_bytes // 2), PACKED).groupBy("block").applyInArrow(_sort_windows(length, blocks), PACKED)
    spans = found.where("kind = 'span'").union(more.where("kind = 'span'")).groupBy("block").applyInArrow(_by_document, "doc long, spans binary")
    out = own.join(spans.withColumnRenamed("doc", "__id"), "__id", "left").withColumn("r", F.arrow_udf(_kept, "n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")("text", "spans"))
    return out.select("doc_id", "r.*")


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], ["key"])


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, for strings of 100 bytes; a null text has no bytes."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are told apart by 128 bits of their digest.
OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i, h FROM t),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM p),
f AS (SELECT x, min((doc_id, i)) AS first FROM w GROUP BY x),
d AS (SELECT w.doc_id, w.i FROM w JOIN f USING (x) WHERE (w.doc_id, w.i) <> f.first),
b AS (SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 1 ELSE 0 END AS new FROM d),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(list_sum(z) - list_sum(a), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE z[k] END) + 1, 2 * ((CASE WHEN k = len(a) THEN len(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE z[k] END)))), '') END)) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""
