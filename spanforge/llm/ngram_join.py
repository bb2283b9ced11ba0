"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are distinct n-gram sets (documents with one set are one row), columns are n-grams.

1.  A set of a linked pair shares at least t times its size with another one. So a set of which more than
    |A| - ceil(t |A|) columns are nobody else's links with nothing. Column blocks count, exactly, which of a part of the
    columns (TESTED times as many as needed, by the column's hash) have one row only; sets that are cleared by these
    are done. What is left (near copies, sets of common n-grams, short ones) is written once, as rows of the matrix.
2.  Of these, column blocks count every column's rows, and send each row its columns of several rows with their
    counts. Two sets with Jaccard >= t share one of the |A| - ceil(t |A|) + 1 rarest columns of each. Only these entries of
    the matrix are dealt out, by column. A column of many rows is cut into slices, with a few of its rows as pivots in
    every slice.
3.  Each column block accumulates, for every row, its overlap counts with its column's head and its neighbour by
    size. The best partners of a row are verified by the full product: exact overlaps of whole sets.
4.  Columns whose rows are then in one component are done. In the others, every pair of rows of different
    components is tested: first against the size-derived bound - J >= t means a symmetric difference of
    at most (|A| + |B|) (1 - t) / (1 + t), which a parity sketch bounds from below - and then exactly. A spanning
    forest of these is verified first, and all that remain if any of it fails.

So no pair of linked sets is lost, no group's pairs are listed, and links are exact (up to 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom
from .common import blocks_for, mix64, save, trim, trimmed, unsave
from .components import components
from .text_hash import sets as sets_of

SLICE = 2048  # rows of a column slice, about
PIVOTS = 32
TESTED = 2.5  # how many times the columns that clear a set are tested


# -- sets ------------------------------------------------------------------------------------------------------


def digest_of(s: np.ndarray) -> int:
    """A set's name: a signed 64-bit digest."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _scan(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, name = [], []
            for s in sets_of(b.column(1), n):
                size.append(len(s))
                name.append(digest_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64())], ["doc_id", "n_shingles", "name"])

    return trimmed(run)


# -- columns of one row --------------------------------------------------------------------------------------------

HELD = 1 << 18  # columns that a task packs at once, about
SEEN = 1 << 16  # names of sets that a task remembers
NOBODY = np.int64(-(2**63))


def _tested(n: int, share: float, blocks: int):
    """The tested columns of distinct sets, by block: names of rows, how many columns each has here, and the columns.

    A column of several of the rows at hand is nobody's own: it goes once, without a row, however frequent it is.
    """
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def packed(sets: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        own = [c[c <= limit] for c in (mix64(s, 21) for s in sets)]
        c, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        if not len(c):
            return
        block, rest = ((c & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64), (c >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((rest, block))
        c = c[order]
        same = c[1:] == c[:-1]
        alone = ~(np.append(same, False) | np.insert(same, 0, False))
        once = order[np.insert(~same, 0, True) & ~alone]  # one of each shared column
        alone = order[alone]
        alone = alone[np.lexsort((row[alone], block[alone]))]
        names = np.array(names, np.int64)
        out = []
        cut = np.flatnonzero(np.concatenate([[True], np.diff(block[alone]) != 0, [True]])) if len(alone) else np.zeros(1, int)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = alone[i:j]
            begins = np.flatnonzero(np.concatenate([[True], np.diff(row[at]) != 0]))
            out.append((int(block[at[0]]), names[row[at[begins]]].tobytes(), np.diff(np.append(begins, len(at))).astype(np.uint32).tobytes(), rest[at].tobytes()))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(block[once]) != 0, [True]])) if len(once) else np.zeros(1, int)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out.append((int(block[once[i]]), NOBODY.tobytes(), np.array([j - i], np.uint32).tobytes(), rest[once[i:j]].tobytes()))
        v = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(v[0], pa.int64()), *(pa.array(x, pa.binary()) for x in v[1:])], ["block", "names", "counts", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, names, seen, size = [], [], set(), 0
        for b in batches:
            for s in sets_of(b.column(0), n):
                if not len(s) or (name := digest_of(s)) in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(name)
                sets.append(s)
                names.append(name)
                size += len(s)
                if size * share > HELD:
                    yield from packed(sets, names)
                    sets, names, size = [], [], 0
            trim()
        if sets:
            yield from packed(sets, names)

    return trimmed(run)


def _own_columns(blocks: int):
    """Of a block's columns, how many of one row each row has, by shard of names."""

    def run(table: pa.Table) -> pa.Table:
        names, counts, columns = (np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()]) for c, k in (("names", np.int64), ("counts", np.uint32), ("columns", np.uint32)))
        each = np.repeat(names, counts)
        order = np.lexsort((each, columns))
        columns, each = columns[order], each[order]
        new = np.concatenate([[True], (columns[1:] != columns[:-1]) | (each[1:] != each[:-1])])  # copies of one set are one row
        columns, each = columns[new], each[new]
        first = np.concatenate([[True], columns[1:] != columns[:-1]])
        own = each[first & np.append(first[1:], True)]
        own, n = np.unique(own[own != NOBODY], return_counts=True)
        shard = (mix64(own.view(np.uint64), 22) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        own, n, shard = own[order], n[order].astype(np.uint32), shard[order]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(own) else np.zeros(1, int)
        rows = [(int(shard[i]), own[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        v = list(zip(*rows, strict=True)) if rows else [[], [], []]
        trim()
        return pa.table({"shard": pa.array(v[0], pa.int64()), "names": pa.array(v[1], pa.binary()), "counts": pa.array(v[2], pa.binary())})

    return run


def _own_totals(table: pa.Table) -> pa.Table:
    names, counts = (np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()]) for c, k in (("names", np.int64), ("counts", np.uint32)))
    name, at = np.unique(names, return_inverse=True)
    return pa.table({"name": pa.array(name), "own": pa.array(np.bincount(at, counts).astype(np.int64))})


def open_names(rows: DataFrame, texts: DataFrame, n: int, num: int, den: int, blocks: int) -> DataFrame:
    """name of the distinct sets that columns of their own don't clear."""
    share = min(1.0, TESTED * (1 - num / den))
    tested = texts.mapInArrow(_tested(n, share, blocks), "block long, names binary, counts binary, columns binary")
    parts = tested.groupBy("block").applyInArrow(_own_columns(blocks), "shard long, names binary, counts binary")
    own = parts.groupBy("shard").applyInArrow(_own_totals, "name long, own long")
    least = F.col("n_shingles") - F.ceil(F.col("n_shingles") * num / den) + 1
    distinct = rows.where("name is not null").groupBy("name").agg(F.max("n_shingles").alias("n_shingles"))
    distinct = distinct.where(F.col("n_shingles") * (den - num) >= num)  # smaller sets link with none but themselves
    return distinct.join(own, "name", "left").where(F.coalesce("own", F.lit(0)) < least).select("name")


def _rows_of(n: int, wanted):
    """name and members of the distinct sets that a Bloom filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = Bloom(wanted.value), set()
        for b in batches:
            names, out, held = [], [], []
            for s in sets_of(b.column(0), n):
                if len(s):
                    held.append(s)
                if len(held) == 1024:
                    _keep(bits, seen, held, names, out)
                    held = []
            _keep(bits, seen, held, names, out)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["name", "members"])

    return trimmed(run)


def _keep(bits: Bloom, seen: set, held: list[np.ndarray], names: list[int], out: list[bytes]) -> None:
    own = [digest_of(s) for s in held]
    if own:
        for d, s, yes in zip(own, held, bits.has(np.array(own, np.int64).view(np.uint64)), strict=True):
            if yes and d not in seen:
                seen.add(d)
                names.append(d)
                out.append(s.tobytes())


# -- the columns that decide ------------------------------------------------------------------------------------

PACKED = "block long, names binary, sizes binary, counts binary, columns binary, rows binary"


def _packed(block: np.ndarray, name: np.ndarray, size: np.ndarray, column: np.ndarray, rows: np.ndarray | None) -> pa.Table:
    """Entries by block: names of rows, their sizes and how many columns each has here, the columns and how many rows those have."""
    order = np.lexsort((name, block))
    block, name, size, column = block[order], name[order], size[order].astype(np.uint32), column[order]
    rows = rows[order].astype(np.uint32) if rows is not None else None
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(1, int)
    out = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        begins = i + np.flatnonzero(np.concatenate([[True], np.diff(name[i:j]) != 0]))
        out.append((int(block[i]), name[begins].tobytes(), size[begins].tobytes(), np.diff(np.append(begins, j)).astype(np.uint32).tobytes(), column[i:j].tobytes(), rows[i:j].tobytes() if rows is not None else None))
    v = list(zip(*out, strict=True)) if out else [[]] * 6
    return pa.table({"block": pa.array(v[0], pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("names", "sizes", "counts", "columns", "rows"), v[1:], strict=True)}})


def _unpacked(table: pa.Table, *more: str) -> list[np.ndarray]:
    """Name, size and column (and rows) of each entry."""
    read = lambda c, k: np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()])
    counts = read("counts", np.uint32)
    return [np.repeat(read("names", np.int64), counts), np.repeat(read("sizes", np.uint32), counts), read("columns", np.uint64), *(read(c, np.uint32) for c in more)]


def _incidences(blocks: int):
    """Every entry of the matrix, by block of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sets, size = [], [], 0

            def out(names, sets):
                n = np.array([len(x) for x in sets])
                c = np.concatenate(sets)
                yield from _packed((mix64(c, 7) % np.uint64(blocks)).astype(np.int64), np.repeat(np.array(names, np.int64), n), np.repeat(n, n), c, None).to_batches()

            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names.append(name)
                sets.append(np.frombuffer(x.as_buffer(), np.uint64))
                size += len(sets[-1])
                if size > HELD:
                    yield from out(names, sets)
                    names, sets, size = [], [], 0
            if sets:
                yield from out(names, sets)
            trim()

    return trimmed(run)


def _frequencies(blocks: int):
    """Of a block's columns, those of several rows with their counts, by shard of rows."""

    def run(table: pa.Table) -> pa.Table:
        name, size, column = _unpacked(table)
        order = np.argsort(column, kind="stable")
        name, size, column = name[order], size[order], column[order]
        first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        n = np.diff(np.append(first, len(column)))
        rows = np.repeat(n, n)
        some = rows > 1
        name, size, column, rows = name[some], size[some], column[some], rows[some]
        out = _packed((mix64(name.view(np.uint64), 23) % np.uint64(blocks)).astype(np.int64), name, size, column, rows)
        trim()
        return out

    return run


def _slices(count: np.ndarray, rows: int) -> np.ndarray:
    return np.maximum(1, -(-count.astype(np.int64) // rows))


def _entries(num: int, den: int, blocks: int, slice_rows: int):
    """Packed entries (column, row, size) of every row's rarest columns, by block of columns and slice.

    Columns of one row are the rarest of all and link nothing, so they are only counted: they are what a row lacks here.
    """

    def run(table: pa.Table) -> pa.Table:
        r, z, c, n = _unpacked(table, "rows")
        order = np.lexsort((c, n, r))
        r, z, c, n = r[order], z[order].astype(np.int64), c[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        held = np.diff(np.append(first, len(r)))
        size = z[first]
        wanted = size + (-num * size) // den + 1 - (size - held)  # of the |A| - ceil(t |A|) + 1 rarest
        keep = np.arange(len(r)) - np.repeat(first, held) < np.repeat(wanted, held)
        r, z, c, n = r[keep], z[keep], c[keep], n[keep]
        cut = _slices(n, slice_rows)
        h = mix64(r.view(np.uint64), 5)
        part = (h % cut.astype(np.uint64)).astype(np.int64)
        pivot = np.flatnonzero((cut > 1) & ((mix64(h, 6) >> np.uint64(32)).astype(np.int64) < PIVOTS * 2**32 // (cut * slice_rows)))
        if len(pivot):  # a few rows of a long column go to all its slices
            more = np.repeat(pivot, cut[pivot])
            into = np.concatenate([np.arange(x) for x in cut[pivot]])
            c, r, z, part, cut = np.concatenate([c, c[more]]), np.concatenate([r, r[more]]), np.concatenate([z, z[more]]), np.concatenate([part, into]), np.concatenate([cut, cut[more]])
        block = ((mix64(c, 7) + part.astype(np.uint64) * np.uint64(0x9E3779B1)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        c, r, z, part, block = c[order], r[order], z[order], part[order] | (cut[order] == 1).astype(np.int64) << 31, block[order]
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(1, int)
        x = [(int(block[i]), c[i:j].tobytes(), r[i:j].tobytes(), z[i:j].astype(np.uint32).tobytes(), part[i:j].astype(np.uint32).tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        v = list(zip(*x, strict=True)) if x else [[]] * 5
        trim()
        return pa.table({"block": pa.array(v[0], pa.int64()), **{k: pa.array(y, pa.binary()) for k, y in zip(("cols", "rows", "sizes", "parts"), v[1:], strict=True)}})

    return run


ENTRIES = "block long, cols binary, rows binary, sizes binary, parts binary"
FOUND = "a long, b long, shared long, size long, part binary, cols binary, rows binary, sizes binary"


def _accumulate(num: int, den: int):
    """Of a block's columns with two rows or more: overlap counts of rows with their heads and neighbours, and the columns' entries."""

    def run(table: pa.Table) -> pa.Table:
        c, r, z, p = (np.concatenate([np.frombuffer(x, k) for x in table[name].to_pylist()]) for name, k in (("cols", np.uint64), ("rows", np.int64), ("sizes", np.uint32), ("parts", np.uint32)))
        order = np.lexsort((r, z, p, c))
        c, r, z, p = c[order], r[order], z[order].astype(np.int64), p[order]
        whole, p = p >> np.uint32(31), p & np.uint32(0x7FFFFFFF)  # the top bit marks columns that are not cut
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        c, r, z, p, whole = c[new], r[new], z[new], p[new], whole[new]
        start = np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
        first = np.flatnonzero(start)
        # in a whole column, rows of which the next smaller and the next larger one differ too much in size are alone
        close = ~start & (np.concatenate([[0], num * z[1:] - den * z[:-1]]) <= 0)
        many = close | np.append(close[1:], False) | (whole[first] == 0).repeat(np.diff(np.append(first, len(c))))
        head = np.repeat(first, np.diff(np.append(first, len(c))))
        i = np.flatnonzero(many & ~start)
        a, b = np.concatenate([r[head[i]], r[i - 1]]), np.concatenate([r[i], r[i]])
        fits = np.concatenate([num * z[i] <= den * z[head[i]], num * z[i] <= den * z[i - 1]]) & (a != b)
        a, b, w = a[fits], b[fits], np.concatenate([z[i], z[i]])[fits]
        order = np.lexsort((a, b))
        a, b, w = a[order], b[order], w[order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.append(cut, len(a)))
        e = len(cut)
        return pa.table({
            "a": pa.array(np.append(a[cut], 0), pa.int64(), mask=np.arange(e + 1) == e), "b": pa.array(np.append(b[cut], 0), pa.int64(), mask=np.arange(e + 1) == e), "shared": pa.array(np.append(shared, 0), pa.int64()), "size": pa.array(np.append(w[cut], 0), pa.int64()),
            "part": pa.array([None] * e + [p[many].tobytes()], pa.binary()), "cols": pa.array([None] * e + [c[many].tobytes()], pa.binary()), "rows": pa.array([None] * e + [r[many].tobytes()], pa.binary()), "sizes": pa.array([None] * e + [z[many].astype(np.uint32).tobytes()], pa.binary()),
        })

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, cols, rows, sizes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cols, np.int64)), pa.array(np.frombuffer(part, np.uint32).astype(np.int64)), pa.array(np.frombuffer(rows, np.int64)), pa.array(np.frombuffer(sizes, np.uint32).astype(np.int64))], ["col", "part", "name", "size"])


# -- whole sets -------------------------------------------------------------------------------------------------


def sketch(s: np.ndarray) -> bytes:
    """The parities of the counts of a set's elements in m cells, m the power of two from |s| on."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1 == 1, bitorder="little").tobytes()


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch of more cells, folded to fewer: cells that fall together add up modulo two."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(1)], pa.binary())], ["name", "sketch"])


def _product(num: int, den: int):
    """Exact overlaps of one row with a slice of others, and which of them reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        out, head, me = [], table["head"].to_pylist(), table["a"][0].as_py()
        if True in head:
            a = np.frombuffer(table["members"][head.index(True)].as_py(), np.uint64)
            for h, name, raw in zip(head, table["name"].to_pylist(), table["members"], strict=True):
                if h:
                    continue
                b = np.frombuffer(raw.as_py(), np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(large, small)
                overlap = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                out.append((name, overlap, den * overlap >= num * (len(a) + len(b) - overlap)))
        return pa.table({"a": pa.array([me] * len(out), pa.int64()), "b": pa.array([x[0] for x in out], pa.int64()), "overlap": pa.array([x[1] for x in out], pa.int64()), "linked": pa.array([x[2] for x in out], pa.bool_())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, overlap, linked of each distinct pair of names; a row's partners are dealt to several tasks, 1024 to each about.

    sets: name and members of every name. Only those in question (a Bloom filter names them) travel to the tasks that
    they are routed to.
    """
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1024).cast("int").alias("slices"))
    right = pairs.join(slices, "a").select(F.col("b").alias("name"), "a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("head"))
    left = slices.select(F.col("a").alias("name"), "a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("head"))
    routes = left.union(right)
    wanted = pairs.sparkSession.sparkContext.broadcast(bloom(routes.select("name")))
    asked = F.arrow_udf(lambda names: pa.array(Bloom(wanted.value).has(names.to_numpy().view(np.uint64))), "boolean")
    return sets.where(asked("name")).join(routes, "name").groupBy("a", "slice").applyInArrow(_product(num, den), "a long, b long, overlap long, linked boolean")


def _near(num: int, den: int, forest: bool):
    """Pairs of a column block's rows of different components whose sketches don't rule them out."""

    def run(table: pa.Table) -> pa.Table:
        col, side, name, size, comp = (table[x].to_numpy() for x in ("col", "side", "name", "size", "comp"))
        order = np.lexsort((name, size, col))
        sk = [np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()]
        found: set[tuple[int, int]] = set()
        ranked = []
        cut = np.flatnonzero(np.concatenate([[True], np.diff(col[order]) != 0, [True]]))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = order[lo:hi]
            if comp[at].min() == comp[at].max():
                continue
            z, own, sides, names = size[at], comp[at], side[at], name[at]
            folded: dict[int, np.ndarray] = {}
            ends = np.searchsorted(z, z * den // num, side="right")
            for i in range(len(at) - 1):
                j = np.arange(i + 1, ends[i])
                j = j[(own[j] != own[i]) & ((sides[j] != sides[i]) | (sides[j] == 2) | (sides[i] == 2))]
                if not len(j):
                    continue
                words = len(sk[at[i]])
                if words not in folded:
                    folded[words] = np.stack([_fold(sk[k], words) if len(sk[k]) >= words else np.zeros(words, np.uint64) for k in at])
                apart = np.bitwise_count(folded[words][j] ^ folded[words][i]).sum(axis=1, dtype=np.int64)
                for k, d in zip(j[apart * (den + num) <= (z[i] + z[j]) * (den - num)].tolist(), apart[apart * (den + num) <= (z[i] + z[j]) * (den - num)].tolist(), strict=True):
                    pair = (int(names[i]), int(names[k]))
                    if pair not in found:
                        found.add(pair)
                        ranked.append((d, pair, int(own[i]), int(own[k])))
        if forest:
            ranked.sort()
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            kept = []
            for _, pair, x, y in ranked:
                if (x := top(x)) != (y := top(y)):
                    up[max(x, y)] = min(x, y)
                    kept.append(pair)
        else:
            kept = [x[1] for x in ranked]
        kept = [(min(p), max(p)) for p in kept] + [(None, None)] * (len(kept) < len(ranked))  # a mark: there are more
        return pa.table({"a": pa.array([p[0] for p in kept], pa.int64()), "b": pa.array([p[1] for p in kept], pa.int64())})

    return run


def set_links(docs: DataFrame, n: int, num: int, den: int, slice_rows: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, name of the set) of each row, and links between names that connect all linked sets."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = save(docs.select("doc_id", "text").mapInArrow(_scan(n), "doc_id long, n_shingles long, name long"), "sets")
    texts = docs.select("text")
    open_ = save(open_names(rows, texts, n, num, den, blocks_for(docs, 32 << 20, least=16)), "open")
    bits = min(27, max(24, (16 * open_.count()).bit_length()))  # 2 to 16 MiB
    wanted = sc.broadcast(bloom(open_, bits))
    sets = save(texts.mapInArrow(_rows_of(n, wanted), "name long, members binary").dropDuplicates(["name"]).join(open_, "name", "left_semi"), "rows")
    blocks = blocks_for(sets, 4 << 20, least=16)
    counted = sets.mapInArrow(_incidences(blocks), PACKED).groupBy("block").applyInArrow(_frequencies(blocks), PACKED)
    entries = counted.groupBy("block").applyInArrow(_entries(num, den, blocks, slice_rows), ENTRIES)
    found = save(entries.groupBy("block").applyInArrow(_accumulate(num, den), FOUND), "columns")
    live = found.where("part is not null").select("part", "cols", "rows", "sizes").mapInArrow(_unpack, "col long, part long, name long, size long")

    pairs = found.where("a is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("size").alias("size"))
    enough = pairs.where(F.col("shared") * 4 >= F.col("size") - F.ceil(F.col("size") * num / den) + 1)
    best = enough.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x"), F.max(F.struct("shared", (-F.col("a")).alias("n"))).alias("y"))
    first = save(best.select(F.explode(F.array_distinct(F.array("x.a", -F.col("y.n")))).alias("a"), "b"), "pairs")
    links = save(verified(first, sets, num, den).where("linked").select("a", "b"), "links")

    sketches = save(sets.mapInArrow(_sketched, "name long, sketch binary"), "sketches")  # small, so sets need not travel
    for forest in (True, False):
        comps = components(links)
        tagged = save(live.distinct().join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn("comp", F.coalesce("component", "name")).select("col", "part", "name", "size", "comp"), "entries")
        mixed = tagged.groupBy("col").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("part").alias("last")).where("lo <> hi").select("col", "last")
        asked = tagged.join(mixed, "col")
        left = asked.join(sketches, "name")
        # slices of a long column meet in pairs; a column of one slice meets itself
        one = left.where("last = 0").select("col", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "name", "size", "comp", "sketch")
        own = F.sequence(F.lit(0), F.col("last"))
        cut = left.where("last > 0").withColumn("o", F.explode(own)).select("col", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), F.when(F.col("o") == F.col("part"), 2).when(F.col("o") > F.col("part"), 0).otherwise(1).alias("side"), "name", "size", "comp", "sketch")
        met = one.union(cut).withColumn("block", F.pmod(F.xxhash64("col", "i", "j"), F.lit(blocks * 4)))
        near = met.groupBy("block").applyInArrow(_met(num, den, forest), "a long, b long")
        near = save(near.distinct(), "near")
        if not near.limit(1).count():
            break
        tested = save(verified(near.where("a is not null"), sets, num, den).select("a", "b", "linked"), "tested")
        links = links.union(tested.where("linked").select("a", "b"))
        if not near.where("a is null").limit(1).count() or not tested.where("not linked").limit(1).count():
            break
    for table in (open_, sets, found, first, sketches):
        unsave(table)
    return rows, links


def _met(num: int, den: int, forest: bool):
    near = _near(num, den, forest)

    def run(table: pa.Table) -> pa.Table:
        # columns of one block are told apart by column and slices
        key = mix64(table["col"].to_numpy().view(np.uint64)) ^ mix64((table["i"].to_numpy().astype(np.int64) * 1_000_003 + table["j"].to_numpy()).view(np.uint64), 3)
        return near(table.set_column(table.schema.get_field_index("col"), "col", pa.array(key.view(np.int64))))

    return run


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, slice_rows: int = SLICE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Documents link when den * |intersection| >= num * |union| of their sets of distinct n-word shingles; a
    component_id is the smallest doc_id that links reach. A text of fewer words is one shingle; a null, empty
    or blank text has none and links with nothing. Rows that repeat a doc_id count each as a document; a null
    doc_id stays null and its component is the smallest id in its group, or null. Other columns of docs are
    left alone and not returned. slice_rows bounds the rows of a column that are looked at together and doesn't
    change the result.
    """
    rows, links = set_links(docs, n, num, den, slice_rows)
    comps = components(links).select(F.col("node").alias("name"), "component")
    named = rows.join(comps, "name", "left").withColumn("group", F.coalesce("component", "name"))
    least = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, for three words and 90 of 100; a text without words has 0 shingles and is alone."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS MATERIALIZED (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, list(doc_id) AS own FROM s WHERE len(s) > 0 GROUP BY 2),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT doc_id AS a, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = g.doc_id), doc_id)) AS component, own FROM g),
m AS (SELECT unnest(own) AS doc_id, component FROM c)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, doc_id) AS component_id FROM s LEFT JOIN m USING (doc_id)
"""
