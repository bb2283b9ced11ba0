"""Spelling variants: a trie self-join of the vocabulary with active-node sets, at distance one.

Words at distance one share a beginning or an end: of two words of which the longer has m code points, either the edit lies
behind the first m // 2 code points, and these are equal, or it lies before, and the last m - m // 2 are. So the vocabulary's
trie is partitioned by such prefixes, and the trie of the reversed words by theirs; a word goes to the partitions of
the two m that it can have (its length, and one more), four rows in all.

In a partition the trie is walked level by level. The active nodes of a node are those at distance one from it: its siblings
(a replaced code point) and its children (an inserted one), which are active anew at each node, and the children by an equal
label of pairs that are active already. Nodes at distance zero are the node itself. Active pairs of two terminal nodes are
words at distance one. A pair is kept once: as (node, sibling) or (node, descendant by one code point more), without the ways
of inserting the same letter elsewhere in a run of it, and from the reversed trie only if the other one hasn't it.

A partition is a set of words with one prefix. One of more than GROUP words is split by one more code point; the active pairs
that split there, whose rest must be equal, are then found by joins on the rest, and so on until all are small enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, trimmed, unsave

GROUP = 200_000  # words of one prefix in one task, at most
CHUNK = 1 << 16  # rows whose tries are walked together, or one group
KEYS = ["side", "band", "root"]
LABELS = np.int64(1 << 21)  # above every code point
PAIRS = "a string, a_n long, b string, b_n long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; none of a null text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))


def vocabulary(words: DataFrame, least: int = 5, often: int = 3) -> DataFrame:
    """word and n of a column `word`: those of at least `least` code points and `often` rows."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


# -- the trie of a chunk ------------------------------------------------------------------------------------------


class Forest:
    """Tries of sorted, distinct (group, rest), level by level: each node's parent, label and row that ends there (or -1)."""

    def __init__(self, group: np.ndarray, rests: list[str]):
        size = np.array([len(x) for x in rests], np.int64)
        points = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        _, node = np.unique(group, return_inverse=True)
        self.levels = [(np.zeros(0, np.int64), np.zeros(0, np.int64), self._ends(node, size, 0, np.arange(len(rests))))]
        row = np.arange(len(rests))
        for depth in range(int(size.max(initial=0))):
            go = size[row] > depth
            row, node = row[go], node[go]
            label = points[start[row] + depth]
            first = np.concatenate([[True], (node[1:] != node[:-1]) | (label[1:] != label[:-1])])
            below = np.cumsum(first) - 1
            self.levels.append((node[first], label[first], self._ends(below, size, depth + 1, row)))
            node = below

    @staticmethod
    def _ends(node: np.ndarray, size: np.ndarray, depth: int, row: np.ndarray) -> np.ndarray:
        out = np.full(int(node.max(initial=-1)) + 1, -1)
        here = size[row] == depth
        out[node[here]] = row[here]
        return out

    def _common(self, x: np.ndarray, y: np.ndarray, depth: int, more: int) -> tuple[np.ndarray, np.ndarray]:
        """Children by an equal label of pairs (x at depth, y at depth + more)."""
        if depth + more + 1 >= len(self.levels) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parent, label, _ = self.levels[depth + 1]
        begin, end = np.searchsorted(parent, x), np.searchsorted(parent, x, side="right")
        pair, child = _ranges(begin, end)
        other, names, _ = self.levels[depth + more + 1]
        keys, wanted = other * LABELS + names, y[pair] * LABELS + label[child]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = keys[at] == wanted
        return child[found], at[found]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows at distance one: of equal length, then of which the second is longer, for each level."""
        same = longer = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for depth, (parent, _, ends) in enumerate(self.levels):
            if depth:
                x, y = self._common(*same, depth - 1, 0)
                i, j = _ranges(np.arange(1, len(parent) + 1), np.searchsorted(parent, parent, side="right"))  # siblings that follow
                same = np.concatenate([x, i]), np.concatenate([y, j])
                x, y = self._common(*longer, depth - 1, 1)
                anew = self.levels[depth + 1][0][y] == x if len(y) else np.zeros(0, bool)
                longer = x[~anew], y[~anew]
            if depth + 1 < len(self.levels):
                below = self.levels[depth + 1][0]
                longer = np.concatenate([longer[0], below]), np.concatenate([longer[1], np.arange(len(below))])
                yield self._rows(ends, self.levels[depth + 1][2], *longer)
            yield self._rows(ends, ends, *same)

    @staticmethod
    def _rows(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = left[x], right[y]
        both = (a >= 0) & (b >= 0)
        return a[both], b[both]


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for every x of begin[i] .. end[i] - 1."""
    size = np.maximum(0, end - begin)
    i = np.repeat(np.arange(len(size)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + begin[i]


def _walk(table: pa.Table) -> pa.RecordBatch:
    """The pairs of whole groups, sorted by group and rest."""
    side, band, n = (table[c].to_numpy() for c in ("side", "band", "n"))
    roots, rests = table["root"].to_pylist(), table["rest"].to_pylist()
    words = [(r + s) if not back else (r + s)[::-1] for r, s, back in zip(roots, rests, side, strict=True)]
    full = np.array([len(w) for w in words]) == band
    root = pc.rank(table["root"], tiebreaker="dense").to_numpy().astype(np.int64)
    change = (side[1:] != side[:-1]) | (band[1:] != band[:-1]) | (root[1:] != root[:-1])
    out_a, out_b = [], []
    for a, b in Forest(np.concatenate([[0], np.cumsum(change)]), rests).pairs():
        keep = full[a] | full[b]  # pairs of the shorter words are the band's before
        a, b = a[keep], b[keep]
        keep = np.array([not side[i] or full[i] or words[i][: band[i] // 2] != words[j][: band[i] // 2] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        out_a.append(a[keep])
        out_b.append(b[keep])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    named = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays([named.take(pa.array(a)), pa.array(n[a]), named.take(pa.array(b)), pa.array(n[b])], ["a", "a_n", "b", "b_n"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks whole groups of a sorted partition, CHUNK rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table[c][-1].as_py() for c in KEYS]
            own = np.ones(len(table), bool)
            for c, v in zip(KEYS, last, strict=True):
                own &= pc.equal(table[c], v).to_numpy()
            cut = len(table) - int(own.sum())  # the last group may go on
            if cut:
                yield _walk(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
    if rows:
        yield _walk(pa.Table.from_batches(held).combine_chunks())


# -- the join -----------------------------------------------------------------------------------------------------


def _spread(words: DataFrame) -> DataFrame:
    """side (false: the word, true: reversed), band (code points of the longer of two), root (the prefix), rest and n."""
    m = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("band")
    sides = words.select("word", "n", m).select("n", "band", F.explode(F.array(F.struct(F.lit(False).alias("side"), F.col("word").alias("w"), F.expr("band div 2").cast("int").alias("k")), F.struct(F.lit(True).alias("side"), F.reverse("word").alias("w"), F.expr("band - band div 2").cast("int").alias("k")))).alias("x"))
    return sides.select("x.side", "band", F.expr("left(x.w, x.k)").alias("root"), F.expr("substring(x.w, x.k + 1)").alias("rest"), "n")


def _split_here(big: DataFrame) -> DataFrame:
    """Pairs of large groups whose edit is at the first code point of the rest: what follows is equal."""
    name = lambda t: f"IF({t}.side, reverse(concat({t}.root, {t}.rest)), concat({t}.root, {t}.rest))"
    long = big.where("rest <> ''").withColumn("tail", F.expr("substring(rest, 2)"))
    on = " AND ".join(f"a.{c} = b.{c}" for c in KEYS)
    both = [F.expr(x) for x in (f"{name('a')} AS a", "a.n AS a_n", f"{name('b')} AS b", "b.n AS b_n", "a.side", "a.band")]
    same = long.alias("a").join(long.alias("b"), F.expr(f"{on} AND a.tail = b.tail")).where("a.rest < b.rest")  # as many as there are code points, at most
    more = big.alias("a").join(long.alias("b"), F.expr(f"{on} AND a.rest = b.tail")).where("left(a.rest, 1) <> left(b.rest, 1)")
    found = same.select(*both).union(more.select(*both))
    return found.where("IF(length(a) = length(b), length(a) = band, NOT side OR left(a, band div 2) <> left(b, band div 2))").select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """a, a_n, b, b_n: each pair of words (word, n; distinct, not empty) that differ by one inserted, deleted or replaced code point, once."""
    rows, found = _spread(words), []
    while True:
        hot = save(rows.groupBy(*KEYS).count().where(F.col("count") > most).select(*KEYS), "hot_prefixes")
        if hot.isEmpty():
            unsave(hot)
            break
        big, rest = save(rows.join(hot, KEYS), "large_groups"), save(rows.join(hot, KEYS, "left_anti"), "small_groups")
        found.append(_split_here(big))
        rows = rest.unionByName(big.where("rest <> ''").select("side", "band", F.expr("concat(root, left(rest, 1))").alias("root"), F.expr("substring(rest, 2)").alias("rest"), "n"))
    pairs = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "rest").mapInArrow(trimmed(_groups), PAIRS)
    for more in found:
        pairs = pairs.union(more)
    return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every row of forms (word, form): the last form that is reached. Pointers double each round."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = save(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unsave(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(words: DataFrame, ratio: float = 2, most: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of words (word string, n long).

    n_near counts the words at distance one (one code point inserted, deleted or replaced). form is the one of the largest n
    (ties: the smallest word in code-point order), if its n is at least ratio (above 1) times the word's; else null. root follows
    forms to the last, and is the word itself without one. Null and empty words have no near words, rows that repeat a word count
    once, with their n added up.
    """
    if ratio <= 1:
        raise ValueError("ratio is above 1: else forms go round in circles")
    own = save(words.groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n")), "words")
    pairs = near_words(own.where("word <> ''"), most)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("form"), F.col("b_n").alias("form_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("form"), F.col("a_n").alias("form_n")))
    best = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    took = F.expr("-best.less >= n * double('%r')" % float(ratio))
    known = own.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(took, F.col("best.form")).alias("form"), F.when(took, -F.col("best.less")).cast("long").alias("form_n"))
    known = save(known, "variants")
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspelt(docs: DataFrame, every: int = 97) -> DataFrame:
    """word of every run of every text, where some runs lose a code point: with h the crc32 of `doc_id:run`, if every divides h, the one at h % length. A null doc_id counts as the word null."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.explode(runs(F.col("text"))).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    cut = f"IF(h % {every} = 0, concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)), run)"
    return hashed.select(F.expr(cut).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of documents, some of whose runs were misspelt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(vocabulary(misspelt(docs))).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = """
WITH RECURSIVE table_of AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)) AS v FROM range(256) AS r(i))),
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
one AS MATERIALIZED (SELECT id, run, count(*) AS n FROM run GROUP BY id, run),
bytes AS (SELECT run, n, list_transform(flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)), lambda x: CAST(x AS UBIGINT)) AS b FROM one),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS h FROM bytes, table_of),
word AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -form_n, w := form)) AS f FROM near GROUP BY word),
known AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.m >= 2 * n THEN f.w END AS form, CASE WHEN -f.m >= 2 * n THEN CAST(-f.m AS BIGINT) END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS top, 1 AS steps FROM known WHERE form IS NOT NULL UNION ALL SELECT walk.word, known.form, steps + 1 FROM walk JOIN known ON known.word = walk.top WHERE known.form IS NOT NULL),
ends AS (SELECT word, arg_max(top, steps) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)
"""
