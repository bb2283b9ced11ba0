"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint and count arrays.

Documents never join on lines. Each scan task packs the hashes of its documents' lines by shard; a shard's
counts are pre-aggregated per task, its minimal perfect hash is built over its distinct hashes, and the packed
probes look their counts up in the shard's arrays. Only the hashes of lines to drop travel back, one row per
document and shard that has any; documents without any (a Bloom filter tells) stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom
from .common import blocks_for, fresh, mix64, save, trim, trimmed

STRIP = b" \t\n\x0b\x0c\r"
LEVELS = 40


# -- the minimal perfect hash ----------------------------------------------------------------------------------


class PerfectHash:
    """Bit-cascade minimal perfect hash over distinct uint64 keys, with a fingerprint and a value for each key.

    Level by level, keys that alone own a bit of the level's bit array stop there; the rest go to the next
    level. A key's index is the rank of its bit. About 3.7 bits a key, 32 more for the fingerprint and 32 for
    the count. Keys left after the last level (none in practice) are kept in a sorted list.
    """

    def __init__(self, sizes, bits, rest, prints, values):
        self.sizes, self.bits, self.rest, self.prints, self.values = sizes, bits, rest, prints, values
        ones = np.unpackbits(bits, bitorder="little")
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ones = ones
        # rank of every 64-bit block, then popcount inside the block
        pad = (-len(ones)) % 64
        self.words = np.packbits(np.concatenate([ones, np.zeros(pad, np.uint8)]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @staticmethod
    def _slot(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(keys, level) % np.uint64(m)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        """keys: distinct uint64; values: uint32 beside them."""
        left, sizes, arrays = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            m = max(64, (len(left) * 3 // 2 + 63) // 64 * 64)
            slot = cls._slot(left, level, m)
            alone = np.bincount(slot, minlength=m) == 1
            arrays.append(alone)
            sizes.append(m)
            left = left[~alone[slot]]
        bits = np.packbits(np.concatenate(arrays) if arrays else np.zeros(0, bool), bitorder="little")
        out = cls(np.array(sizes, np.int64), bits, np.sort(left), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        at = out.index(keys)
        out.prints[at] = cls.fingerprint(keys)
        out.values[at] = values
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys, LEVELS + 1) >> np.uint64(32)).astype(np.uint32)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for a key that falls through every level."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.starts[level] + self._slot(keys[todo], level, int(m))
            hit = self.ones[at] == 1
            p = at[hit]
            inside = self.words[p >> 6] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))
            out[todo[hit]] = self.before[p >> 6] + np.bitwise_count(inside)
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            i = np.searchsorted(self.rest, keys[todo])
            ok = (i < len(self.rest)) & (self.rest[np.minimum(i, len(self.rest) - 1)] == keys[todo])
            out[todo[ok]] = self.before[-1] + i[ok]
        return out

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where the fingerprint says that it isn't one of the index's keys."""
        if not len(self.values):
            return np.zeros(len(keys), np.uint32)
        at = self.index(keys)
        known = (at >= 0) & (self.prints[np.maximum(at, 0)] == self.fingerprint(keys))
        return np.where(known, self.values[np.maximum(at, 0)], 0)

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.sizes, self.bits, self.rest, self.prints, self.values)]

    @classmethod
    def of(cls, parts: list[bytes]) -> PerfectHash:
        kinds = (np.int64, np.uint8, np.uint64, np.uint32, np.uint32)
        return cls(*(np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)))


# -- lines ----------------------------------------------------------------------------------------------------


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and their keys, as UTF-8."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(STRIP).lower() for x in lines]


def _long(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least


def _probes(shards: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            hashes, owners, salts = [], [], []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for key, text in zip(ids, batch.column(1), strict=True):
                if (value := text.as_py()) is None:
                    continue
                own = {h64(k) for k in set(line_keys(value)[1]) if k and (least <= 1 or _long(k, least))}
                hashes.extend(own)
                owners.extend([key] * len(own))
            if not hashes:
                continue
            h, o = np.array(hashes, np.uint64), np.array(owners, np.int64)
            shard = (mix64(h, 77) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            h, o, shard = h[order], o[order], shard[order]
            cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
            rows = [(int(shard[a]), h[a:b].tobytes(), o[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            s, hb, ob = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(hb, pa.binary()), pa.array(ob, pa.binary())], ["shard", "hashes", "owners"])

    return trimmed(run)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard and batch of packed probes: distinct hashes and in how many documents they are."""
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(s, []).append(np.frombuffer(h, np.uint64))
        rows = []
        for s, hs in by.items():
            keys, counts = np.unique(np.concatenate(hs), return_counts=True)
            rows.append((s, keys.tobytes(), counts.astype(np.uint32).tobytes()))
        if rows:
            s, k, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["shard", "hashes", "counts"])


def _build(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.minimum(np.add.reduceat(counts, first), 2**32 - 1).astype(np.uint32)
    parts = PerfectHash.build(keys[first], total).parts()
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), **{n: pa.array([p], pa.binary()) for n, p in zip(("sizes", "bits", "rest", "prints", "counts"), parts, strict=True)}})


INDEX_SCHEMA = "shard long, sizes binary, bits binary, rest binary, prints binary, counts binary"


def line_index(probes: DataFrame) -> DataFrame:
    """The sharded perfect hash: one row for each shard."""
    return probes.select("shard", "hashes").mapInArrow(_partial_counts, "shard long, hashes binary, counts binary").groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def _probe(least: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        out_o, out_h = [], []
        if probes.num_rows and index.num_rows:
            mph = PerfectHash.of([index[n][0].as_py() for n in ("sizes", "bits", "rest", "prints", "counts")])
            for hb, ob in zip(probes["hashes"].to_pylist(), probes["owners"].to_pylist(), strict=True):
                h, o = np.frombuffer(hb, np.uint64), np.frombuffer(ob, np.int64)
                hot = mph.get(h) >= least
                h, o = h[hot], o[hot]
                if len(h):
                    order = np.argsort(o, kind="stable")
                    h, o = h[order], o[order]
                    cut = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]]))
                    out_o.append(o[cut[:-1]])
                    out_h += [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        owners = np.concatenate(out_o) if out_o else np.zeros(0, np.int64)
        return pa.table({"owner": pa.array(owners, pa.int64()), "hot": pa.array(out_h, pa.binary())})

    return run


def _drop(min_chars: int):
    def run(texts: pa.Array, hot: pa.Array) -> pa.Array:
        h64 = xxhash.xxh3_64_intdigest
        kept, n, gone = [], [], []
        for text, bad in zip(texts.to_pylist(), hot.to_pylist(), strict=True):
            if not bad:
                kept.append(text or "")
                n.append((text or "").count("\n") + 1)
                gone.append(0)
                continue
            lines, keys = line_keys(text)
            drop = set(np.frombuffer(b"".join(bad), np.uint64).tolist())
            left = [x for x, k in zip(lines, keys, strict=True) if not (k and (min_chars <= 1 or _long(k, min_chars)) and h64(k) in drop)]
            kept.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
            n.append(len(lines))
            gone.append(len(lines) - len(left))
        trim()
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_lines", "n_dropped"])

    return F.arrow_udf(run, "text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, probe_bytes: int = 64 << 20) -> DataFrame:
    """Drop every line whose key is found in at least min_docs documents.

    A key is the line stripped of ASCII white space with A-Z lower-cased; keys shorter than min_chars code
    points never count. Each row of docs is a document of its own, whatever its doc_id. Returns docs' columns
    with text replaced, and n_lines, n_dropped (columns of those names are replaced). A null text is one empty
    line and comes back as ''; an empty table gives an empty table. Hashes have 64 bits.

    A shard's probes are dealt to as many tasks as their bytes ask for (probe_bytes each), so a line that a
    third of all documents hold loads no single task.
    """
    spark = docs.sparkSession
    shards = blocks_for(docs, 16 << 20)
    owner, lines, result, hit = (fresh(c, docs.columns) for c in ("owner", "hot", "r", "hit"))
    keyed = docs.withColumn(owner, F.xxhash64("doc_id", "text"))
    probes = save(keyed.select(owner, "text").mapInArrow(_probes(shards, min_chars), "shard long, hashes binary, owners binary"), "line-probes")
    index = save(line_index(probes), "line-index")
    size = probes.groupBy("shard").agg(F.sum(F.length("hashes")).alias("bytes")).select("shard", F.ceil(F.col("bytes") / probe_bytes).cast("int").alias("salts"))
    dealt = probes.join(F.broadcast(size), "shard").withColumn("salt", F.pmod(F.xxhash64("hashes"), F.col("salts")).cast("int"))
    copies = index.join(F.broadcast(size), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    answers = dealt.select("shard", "salt", "hashes", "owners").groupBy("shard", "salt").cogroup(copies.drop("salts").groupBy("shard", "salt")).applyInArrow(_probe(min_docs), "owner long, hot binary")
    hot = save(answers.groupBy(F.col("owner").alias(owner)).agg(F.collect_list("hot").alias(lines)), "line-drops")
    bits = min(27, max(22, (16 * hot.count()).bit_length()))  # half a MiB to 16 MiB; what it lets through is only joined for nothing
    wanted = spark.sparkContext.broadcast(bloom(hot.select(owner), bits))
    flagged = keyed.withColumn(hit, F.arrow_udf(lambda o: pa.array(Bloom(wanted.value).has(o.to_numpy().view(np.uint64))), "boolean")(owner))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # a merge at every size: the lists grow with the documents, and so would a broadcast of them
    changed = flagged.where(hit).join(hot.hint("merge"), owner, "left").withColumn(result, _drop(min_chars)("text", lines))
    changed = changed.select(*[F.col(f"{result}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in order], f"{result}.n_lines", f"{result}.n_dropped")
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    same = flagged.where(~F.col(hit)).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in order], n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return changed.union(same)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document; a null or empty text is one empty line, of which nothing is dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
