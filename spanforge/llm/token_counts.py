"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves are blocks of whole pre-tokens, cut between two characters
that the pre-token pattern parts whatever stands around them (white space after other text, letters beside digits or
signs). A run without such a place - unbroken script, a long base64 word - is cut where no entry of the vocabulary
spans the cut, since no merge can cross it. So a leaf's tokens depend on its text alone. Edits re-encode the leaves
that they touch, with those beside them whose cut their context decides, and update the sums above them.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_CHARS = 64
SIZE = np.uint32(2**31 - 1)
CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
#: As CUT, inside a run of other text than white space: letters beside digits, either beside ASCII signs.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯぁ-ゖ一-鿿가-힣"
INNER = re.compile(f"(?<=[{_LETTER}])(?=[0-9!-/:-@\\[-`{{-~])|(?<=[0-9])(?=[{_LETTER}!-/:-@\\[-`{{-~])|(?<=[!-&(-/:-@\\[-`{{-~])(?=[{_LETTER}0-9])")


class Encoder:
    """Counts the tokens of a text under a tiktoken rank file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        return len(self.encode(text))

    @functools.cached_property
    def prefixes(self) -> set[bytes]:
        """Every proper beginning of a vocabulary entry."""
        return {t[:i] for t in self.ranks for i in range(1, len(t))}

    @functools.cached_property
    def reach(self) -> int:
        """How far to either side of a cut, in characters, an entry that spans it could lie."""
        return max(map(len, self.ranks))

    def spanned(self, left: bytes, right: bytes) -> bool:
        """Whether an entry is made of an end of left and a beginning of right."""
        for i in range(1, min(len(left), self.reach) + 1):
            if (t := left[-i:]) in self.prefixes:
                for c in range(len(right)):
                    t += right[c : c + 1]
                    if t in self.ranks:
                        return True
                    if t not in self.prefixes:
                        break
        return False


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def _inner_cut(text: str, at: int, stop: int, count: Encoder) -> tuple[int, bool]:
    """A cut of a stretch at `at` or behind, and whether its context decides it; (stop, False) without any."""
    m = INNER.search(text, at, stop)
    edge = m.start() if m else stop
    for p in range(at, min(edge, stop, at + 16 * LEAF_CHARS)):
        if text[p - 2 : p + 1].isalpha() and not count.spanned(text[max(0, p - count.reach) : p].encode("utf-8", "surrogatepass"), text[p : p + count.reach].encode("utf-8", "surrogatepass")):
            return p, True
    return edge, False


def leaves(text: str, count: Encoder, size: int = LEAF_CHARS) -> tuple[list[str], list[bool]]:
    """text in blocks of size characters about, and of each whether the cut before it hangs on its context."""
    out, soft, at, held = [], [], 0, False

    def take(stop: int, next_held: bool) -> None:
        nonlocal at, held
        out.append(text[at:stop])
        soft.append(held)
        at, held = stop, next_held

    while len(text) - at > size:
        m = CUT.search(text, at + size)
        stop = m.start() if m else len(text)
        while stop - at > 8 * size:  # a stretch without white space, or of nothing else
            p, h = _inner_cut(text, at + size, stop, count)
            if p >= stop:
                break
            take(p, h)
        if stop >= len(text):
            break
        take(stop, False)
    take(len(text), False)
    return out, soft


class SegmentTree:
    """Sums of (characters, tokens) over leaves, in an implicit binary tree: node i has children 2i and 2i + 1."""

    def __init__(self, sums: np.ndarray, leaves: int):
        self.sums, self.leaves = sums, leaves
        self.base = len(sums) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        base = 1 << max(0, (len(chars) - 1).bit_length())
        sums = np.zeros((2 * base, 2), np.int64)
        sums[base : base + len(chars), 0], sums[base : base + len(chars), 1] = chars, tokens
        step = base
        while step > 1:
            half = step // 2
            sums[half:step] = sums[step : 2 * step : 2] + sums[step + 1 : 2 * step : 2]
            step = half
        return cls(sums, len(chars))

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character offset, and where it begins."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if char - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.base, self.leaves - 1), start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.base + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def spliced(self, first: int, last: int, chars: list[int], tokens: list[int]) -> SegmentTree:
        """The tree with leaves first to last replaced: sums above them where as many come, else the sums anew."""
        if len(chars) == last - first + 1:
            for k, (c, t) in enumerate(zip(chars, tokens, strict=True)):
                self.put(first + k, c, t)
            return self
        own = self.sums[self.base : self.base + self.leaves]
        both = np.concatenate([own[:first], np.array([chars, tokens], np.int64).T.reshape(-1, 2), own[last + 1 :]])
        return SegmentTree.of(both[:, 0], both[:, 1])

class Counted:
    """A text in leaves, with the tree over them."""

    def __init__(self, text: str, count: Encoder, packed: bytes | None = None):
        self.count, self.reencoded = count, 0
        rows = np.frombuffer(packed or b"", "<u4").reshape(-1, 2)
        stops = np.cumsum(rows[:, 0] & SIZE).tolist()
        if stops and stops[-1] == len(text):
            self.leaves = [text[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            self.soft = (rows[:, 0] > SIZE).tolist()
            self.tree = SegmentTree.of(rows[:, 0] & SIZE, rows[:, 1])
        else:  # no tree, or another text's
            self.leaves, self.soft = leaves(text, count)
            self.tree = SegmentTree.of([len(x) for x in self.leaves], [count(x) if x else 0 for x in self.leaves])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _widened(self, start: int, stop: int, a: int, b: int, begin: int, end: int) -> tuple[int, int, int]:
        """Leaves a to b, from begin to end, with those beside them whose cuts hang on what start:stop may change."""
        while a and self.soft[a] and start - begin < self.count.reach:
            a -= 1
            begin -= len(self.leaves[a])
        while b + 1 < len(self.leaves) and self.soft[b + 1] and end - stop < self.count.reach:
            b += 1
            end += len(self.leaves[b])
        return a, b, begin

    def _replace(self, a: int, b: int, region: str) -> None:
        parts, soft = leaves(region, self.count)
        soft[0] = self.soft[a]
        self.reencoded += len(region)
        self.tree = self.tree.spliced(a, b, [len(x) for x in parts], [self.count(x) if x else 0 for x in parts])
        self.leaves[a : b + 1], self.soft[a : b + 1] = parts, soft

    def pack(self) -> bytes:
        """Little-endian pairs of characters and tokens, a leaf each; the top bit of the first marks a cut that hangs on its context."""
        rows = self.tree.sums[self.tree.base : self.tree.base + self.tree.leaves].astype("<u4")
        rows[:, 0] |= np.array(self.soft, "<u4") << np.uint32(31)
        return rows.tobytes()

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop] (offsets of the text as it is now, clipped to it)."""
        start = min(max(0, start), self.tree.chars)
        stop = min(max(start, stop), self.tree.chars)
        last = max(0, self.tree.chars - 1)
        # the characters on both sides of a touched cut belong to the context
        a, begin = self.tree.find(min(max(0, start - 3), last))
        b, end = self.tree.find(min(stop + 2, last))
        a, b, begin = self._widened(start, stop, a, b, begin, end + len(self.leaves[b]))
        old = "".join(self.leaves[a : b + 1])
        self._replace(a, b, old[: start - begin] + new + old[stop - begin :])

    def edit_all(self, changes: list[tuple[int, int, str]]) -> None:
        """Edits with offsets of the text as it is, from the last to the first; those that touch the same leaves are encoded once."""
        changes = sorted(((min(max(0, a), self.tree.chars), b, new) for a, b, new in changes), key=lambda c: c[:2], reverse=True)
        changes = [(a, min(max(a, b), self.tree.chars), new) for a, b, new in changes]
        if any(low[1] > high[0] for high, low in zip(changes[:-1], changes[1:], strict=True)):  # overlaps: one by one
            for c in changes:
                self.edit(*c)
            return
        if not changes:
            return
        stops = np.cumsum(self.tree.sums[self.tree.base : self.tree.base + self.tree.leaves, 0])
        starts, last = stops - self.tree.sums[self.tree.base : self.tree.base + self.tree.leaves, 0], max(0, self.tree.chars - 1)
        firsts = np.searchsorted(starts, np.clip([c[0] - 3 for c in changes], 0, last), side="right") - 1
        lasts = np.searchsorted(starts, np.clip([c[1] + 2 for c in changes], 0, last), side="right") - 1
        groups: list[list] = []  # from the last to the first: first leaf, last leaf, begin, changes
        for c, a, b, begin, end in zip(changes, firsts.tolist(), lasts.tolist(), starts[firsts].tolist(), stops[lasts].tolist(), strict=True):
            if self.soft[a] or b + 1 < len(self.leaves):
                a, b, begin = self._widened(c[0], c[1], a, b, begin, end)
            if groups and b >= groups[-1][0]:
                g = groups[-1]
                g[0], g[2] = (a, begin) if a < g[0] else (g[0], g[2])
                g[1] = max(g[1], b)
                g[3].append(c)
            else:
                groups.append([a, b, begin, [c]])
        for a, b, begin, own in groups:
            old = "".join(self.leaves[a : b + 1])
            for start, stop, new in own:
                old = old[: start - begin] + new + old[stop - begin :]
            self._replace(a, b, old)


TREE = "doc_id long, n_tokens long, tree binary"


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the packed tree (see Counted.pack) of each row.

    A null text counts as empty: 0 tokens, one empty leaf. Repeated ids are counted each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            own = [Counted(t.as_py() or "", count) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.tree.tokens for d in own], pa.int64()), pa.array([d.pack() for d in own], pa.binary())], ["doc_id", "n_tokens", "tree"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TREE)


EDITS = "array<struct<start: int, stop: int, new: string>>"


def recount(docs: DataFrame, edits: str = "edits", tree: str | None = None, path: str | None = None) -> DataFrame:
    """docs' doc_id with n_tokens, n_edits, n_tokens_edited, n_reencoded, text (edited) and tree (packed, updated).

    edits names a column of array<struct<start, stop, new>>: offsets in characters of the unedited text, applied
    from the last to the first by (start, stop), so that none moves another; overlapping ones are applied in
    that order to what is there. A null array or element, or null offsets, edit nothing; a null `new` deletes. tree
    names a column of packed trees that build() or recount() gave; without it (or where it is null, or of a text of
    another length) trees are built first. n_reencoded counts the characters encoded for the edits: the leaves that they
    touch and their context, however long the text. Rows that repeat a doc_id, or have none, are counted each.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(edits).cast(EDITS).alias("edits"), (F.col(tree) if tree else F.lit(None)).cast("binary").alias("tree")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for b in batches:
            out = []
            for text, changes, packed in zip(b.column(1), b.column(2), b.column(3), strict=True):
                doc = Counted(text.as_py() or "", count, packed.as_py())
                before = doc.tree.tokens
                own = [(c["start"], c["stop"], c["new"] or "") for c in changes.as_py() or [] if c and c["start"] is not None and c["stop"] is not None]
                doc.edit_all(own)
                out.append((before, len(own), doc.tree.tokens, doc.reencoded, doc.text, doc.pack()))
            v = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in v[:4]), pa.array(v[4], pa.string()), pa.array(v[5], pa.binary())], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded", "text", "tree"])

    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long, text string, tree binary")


#: What a cleaning pass edits: e-mail addresses become a mark, runs of one sign shrink to one.
CLEAN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|([*$#%&!])\1{2,}")


def cleaning_edits(column) -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        out = [[{"start": m.start(), "stop": m.end(), "new": m[1] or "<email>"} for m in CLEAN.finditer(t)] if t else [] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())])))

    return F.arrow_udf(run, EDITS)(column)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited and n_reencoded of every document: counts before and after a cleaning pass, which is applied as edits. Null texts count 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return recount(docs.withColumn("edits", cleaning_edits("text"))).select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")
