"""Spelling variants against comparisons of all pairs."""

import collections
import random
import re
import zlib

import pytest

from spanforge.llm import spelling as s


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def plain(words, ratio=2):
    """word: (n, n_near, form, form_n, root)"""
    out = {}
    for w, n in words.items():
        beside = [(-m, v) for v, m in words.items() if w and v and near(w, v)]
        m, v = min(beside, default=(0, None))
        out[w] = (n, len(beside), *((v, -m) if v is not None and -m >= ratio * n else (None, None)))
    for w, x in out.items():
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        out[w] = (*x, at)
    return out


def some(rnd, n, letters, longest):
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, longest))): rnd.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize(("most", "chunk"), [(s.GROUP, s.CHUNK), (3, 1), (20, 50)])
def test_all_pairs(spark, monkeypatch, most, chunk):
    """Runs of letters, accents, ties and very long words, in groups that are split and in chunks that end anywhere."""
    rnd = random.Random(13)
    long = "ab" * 700
    words = some(rnd, 250, "ab", 8) | some(rnd, 150, "aéz😀", 5) | some(rnd, 60, "a", 12) | {long: 9, long[1:]: 3, long[:700] + "c" + long[700:]: 4, "x" + long[1:]: 1, long[:-1] + "x": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    monkeypatch.setattr(s, "CHUNK", chunk)
    pairs = [(r["a"], r["b"]) for r in s.near_words(df, most).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})  # each once
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    if most != 3:
        got = {r["word"]: tuple(r)[1:] for r in s.spelling_variants(df, most=most).collect()}
        assert got == plain(words)


def test_forest_levels():
    """One chunk's tries: pairs of equal length and of one more, each once, within groups only."""
    import numpy as np

    rows = [(g, w) for g in range(3) for w in sorted({"", "a", "aa", "aab", "ab", "ba", "bab", "b", "aaa"} if g < 2 else {"q"})]
    f = s.Forest(np.array([g for g, _ in rows]), [w for _, w in rows])
    got = [tuple(sorted((i, j))) for a, b in f.pairs() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i, (g, x) in enumerate(rows) for j, (h, y) in enumerate(rows) if i < j and g == h and near(x, y)]
    assert sorted(got) == want


def test_forms_and_odd_rows(spark):
    """Chains of forms, ties for the smaller word, nulls, empty and repeated words, columns beside, nothing."""
    words = {"color": 40, "colour": 20, "colours": 10, "colourz": 10, "coloursx": 4, "zebra": 3, "zebrb": 3, "": 7, "hello": 8, "hallo": 16, "hullo": 16}
    rows = [(w, n, "x") for w, n in words.items()] + [(None, 4, "y")] + [("color", 1, "z")]
    words["color"] = 41
    df = spark.createDataFrame(rows, "word string, n long, form string").select("word", "n")
    got = {r["word"]: tuple(r)[1:] for r in s.spelling_variants(df).collect()}
    assert got.pop(None) == (4, 0, None, None, None)
    assert got == plain(words)
    assert got["coloursx"][4] == "color" and got["hello"][2] == "hallo" and got["zebra"][1:3] == (1, None)
    assert s.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        s.spelling_variants(df, ratio=1)


def test_runs_and_misspelling(spark):
    texts = [None, "", "Hello, wörld÷×ÄÖ it's 12 Ünïcode ſtraße x", "A" * 5000, "hello " * 400, "\x1fab\ncd Éa"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, word int").repartition(2)
    want = collections.Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            for every in (97, 2):
                h = zlib.crc32(f"{i if i != 4 else 'null'}:{run}".encode())
                want[every, run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    for every in (97, 2):
        got = s.misspelt(docs, every)
        assert {(every, r["word"]): r["count"] for r in got.groupBy("word").count().collect()} == {k: n for k, n in want.items() if k[0] == every}
        assert {r["word"]: r["n"] for r in s.vocabulary(got, 2, 3).collect()} == {w: n for (e, w), n in want.items() if e == every and n >= 3 and len(w) >= 2}
