"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import ann, bloom, bpe, components, embedding_dedup, line_dedup, mixing, ngram_join, quality, select, sharding, suffix_dedup, text_hash, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "one two", "é́ x\x1cy z", "😀 <|endoftext|> it's 12", "\x0b\ta \r\n b", "word " * 3000]


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(parts)


def prose(rnd, n, words=400):
    vocabulary = ["".join(rnd.choice(["th", "an", "er", "on", "ti", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


# -- shared parts -------------------------------------------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1050)] + [(5000, 5000 + i) for i in range(40)] + [(None, 1), (7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: top(x) for x in up}
    most, components.TASK_LINKS = components.TASK_LINKS, 20  # the driver's bound: star steps over the cluster
    try:
        assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: top(x) for x in up}
    finally:
        components.TASK_LINKS = most
    assert components.components(df.limit(0)).count() == 0


def test_bloom_and_kth(spark):
    keys = spark.range(0, 5000).select((F.col("id") * 7919).alias("k"))
    b = bloom.Bloom(bloom.bloom(keys, 20))
    assert b.has(np.arange(0, 5000 * 7919, 7919, dtype=np.int64).view(np.uint64)).all()
    assert b.has(np.arange(1, 10**6, 7919, dtype=np.int64).view(np.uint64)).mean() < 0.05
    df = spark.createDataFrame([(float(x),) for x in [3, -1e6, 2.5, 2.5, 7e5, 0]] + [(None,), (float("nan"),)], "x double")
    assert [select.kth_largest(df, "x", k) for k in range(1, 8)] == [7e5, 3.0, 2.5, 2.5, 0.0, -1e6, None]


def test_text_hashes():
    import pyarrow as pa

    texts = [*ODD, "A b a B a b c", "x" * 10]
    for n in (1, 2, 3, 5):
        got = list(text_hash.sets(pa.array(texts), n))
        for t, s in zip(texts, got, strict=True):
            w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
            assert len(s) == len({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(1, len(w))))}), (t, n)
    rnd = random.Random(12)
    texts = [prose(rnd, 300) + "," + prose(rnd, 40), None, "x" * 200, "a b", " " * 90, prose(rnd, 3)]
    for kind in (None, text_hash._KIND):  # pieces of a long text give what the whole gives
        flat = lambda most: [h[a:b].tolist() for _, h, at in text_hash.words(pa.array(texts), kind, most) for a, b in zip(at[:-1], at[1:], strict=True)]  # noqa: B023, E731
        assert flat(50) == flat(1 << 20)
    whole = [len(h) for _, h, _ in text_hash.tokens(pa.array(["ab,cd!! é"]))]
    assert whole == [5]


# -- 1 -------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    count = token_counts.encoder()
    rnd = random.Random(1)
    for t in [*[t or "" for t in ODD], prose(rnd, 900), "a\n\n b  c\t d" * 90]:
        doc = token_counts.Counted(t, count)
        assert doc.tree.tokens == count(t)
        for _ in range(12):
            a = rnd.randrange(len(doc.text) + 1)
            doc.edit(a, a + rnd.choice([0, 1, 5, 600]), rnd.choice(["", " ", "x", "\n", "'s 12", "é  ", prose(rnd, 300)]))
            assert doc.tree.tokens == count(doc.text) and doc.tree.chars == len(doc.text)
    edits = [[(0, 1, "zz"), (5, 9, None), (None, 2, "x")], None, []]
    docs = spark.createDataFrame([(i, t, edits[i % 3]) for i, t in enumerate(ODD)], "doc_id long, text string, edits array<struct<start:int,stop:int,new:string>>")
    built = token_counts.build(docs)
    rows = token_counts.recount(docs.join(built.select("doc_id", "tree"), "doc_id"), tree="tree").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["n_tokens"] == count(ODD[r["doc_id"]] or "") and r["n_tokens_edited"] == count(r["text"])
    again = spark.createDataFrame([(r["doc_id"], r["text"], [(0, 1, "Q")], bytes(r["tree"])) for r in rows], "doc_id long, text string, edits array<struct<start:int,stop:int,new:string>>, tree binary")
    for r in token_counts.recount(again, tree="tree").collect():  # trees of edited texts serve on
        assert r["n_tokens_edited"] == count(r["text"])
    assert token_counts.recount(docs.limit(0)).count() == 0


def test_token_counts_encode_what_edits_touch():
    count = token_counts.encoder()
    rnd = random.Random(11)
    pick = lambda signs, n: "".join(rnd.choice(signs) for _ in range(n))
    texts = [prose(rnd, 5000), pick("的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生", 20_000), pick("abcdefghijklmnopqrstuvwxyz", 20_000), pick("ABCdefGHIjkl0123456789+/", 20_000), "don't 12a34'll²3" * 900]
    for t in texts:
        doc = token_counts.Counted(t, count)
        assert doc.tree.tokens == count(t)
        for k in range(25):
            a, before = rnd.randrange(len(doc.text)), doc.reencoded
            new = rnd.choice(["", "Q", " ", "字", "9", "'", "ll x", "\n"])
            doc.edit(a, a + rnd.choice([0, 1, 7]), new)
            assert doc.tree.tokens == count(doc.text) and doc.tree.chars == len(doc.text) and doc.reencoded - before < 40 * token_counts.LEAF_CHARS
        for _ in range(3):  # large insertions make leaves of their own
            doc.edit(100, 100, prose(rnd, 4000))
        before = doc.reencoded
        doc.edit(9000, 9001, "z")
        assert doc.reencoded - before < 10 * token_counts.LEAF_CHARS and doc.tree.tokens == count(doc.text)
    doc = token_counts.Counted(texts[0], count)
    doc.edit_all([(10 * k, 10 * k + 3, "#" * (k % 3)) for k in range(1500)])
    want = texts[0]
    for k in reversed(range(1500)):
        want = want[: 10 * k] + "#" * (k % 3) + want[10 * k + 3 :]
    assert doc.text == want and doc.tree.tokens == count(want) and doc.reencoded < 1.2 * len(texts[0])  # neighbours are encoded once
    doc.edit_all([(5, 9, "x"), (7, 12, "yy"), (-3, 2, None or "")])
    assert doc.tree.tokens == count(doc.text)
    long = token_counts.Counted(prose(rnd, 400_000), count)  # above two million characters
    long.edit(1_000_000, 1_000_001, "Q")
    assert long.reencoded < 10 * token_counts.LEAF_CHARS and long.tree.tokens == count(long.text)


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_embedding_near_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows, n = [], 0
    for k in range(60):
        for _ in range([1, 1, 2, 5][k % 4]):
            rows.append((n, (base[k] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 0.2])).tolist(), k % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, [2 * x for x in rows[0][1]], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, [1.0, None], 1), (n + 6, rows[0][1], None), (n + 7, [1.0, 0.0], 0), (n + 8, [1.0, 0.01], 0), (n + 9, [], 0)]
    dense = base[1] + rng.standard_normal((700, 16)) * 0.02
    rows += [(10_000 + i, v.tolist(), 1) for i, v in enumerate(dense)]
    links, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    good = [(i, np.array(v), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None]
    for lab in range(3):
        for d in (2, 16):
            own = [(i, v / np.linalg.norm(v)) for i, v, x in good if x == lab and len(v) == d]
            if own:
                x = np.stack([v for _, v in own])
                for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
                    i, j = own[a][0], own[b][0]
                    links[i] += 1
                    links[j] += 1
                    p, q = top(i), top(j)
                    up[max(p, q)] = min(p, q)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_dedup(df).collect()}
    assert got == {i: (links[i], top(i), top(i) == i) for i in up}
    assert embedding_dedup.near_dedup(df.limit(0)).count() == 0


# -- 3 and 4 -------------------------------------------------------------------------------------------------------


def labelled(spark, n=900):
    rnd = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        t, q, x = prose(random.Random(i % 400), rnd.randint(60, 200)), 1, 0
        if i % 6 == 0:
            t, q = " ".join(w + "###" for w in t.split()), 0
        elif i % 6 == 1:
            words = t.split()
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vilest", "rotten"]))
            t, x = " ".join(words), 1
        texts.append(t)
        labels.append((i, q, x))
    return frame(spark, [*texts, *ODD]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    out = quality.select(docs.withColumn("score", F.lit("clash")), labels.where("doc_id % 4 < 2")).join(labels, "doc_id").where("doc_id % 4 >= 2").collect()
    good = [r["selected"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["selected"] for r in out if r["quality"] == 0 or r["toxic"] == 1]
    assert len(good) > 100 and np.mean(good) > 0.95 and np.mean(bad) < 0.15
    k = quality.select(docs, labels, share=0.25)
    assert k.where("selected").count() == round(0.25 * docs.count()) and k.count() == docs.count()
    assert quality.select(docs, labels.limit(0)).where("selected").count() == docs.count()
    assert quality.select(docs.limit(0), labels).count() == 0


def test_models_and_gumbel_top_k_by_hand(spark):
    """The models counted in plain Python, and the selection replayed from their weights."""
    import pyarrow as pa

    docs, labels = labelled(spark, 300)
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 1), (4, 1, None), (5, 1, 0), (5, 1, 0), (5, 1, 0)], labels.schema)  # null labels, and rows that repeat one
    both = quality.fit(docs, labels.union(odd), raw=True)
    model = quality.fit(docs, labels.union(odd), raw=True, doubt=quality.MARKED, markers=True)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kinds = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    names = [(1, 0), (0, 0), (1, 1)]
    size = 1 << quality.LOG_BUCKETS
    counts, corpus, known, seen = {n: np.zeros(size) for n in names}, np.zeros(size), np.zeros(size), set()
    bag = lambda t: np.bincount(np.concatenate([b for _, b, _ in quality.features(pa.array([t], pa.string()))]), minlength=size)
    for i, t in texts.items():
        corpus += bag(t)
        if i in kinds:
            known += bag(t)
            for line in (t or "").split("\n"):
                if line and (kinds[i], line) not in seen:
                    seen.add((kinds[i], line))
                    counts[kinds[i]] += bag(line)

    def ratio(a, b, doubt):
        even = b.sum() / a.sum()
        r = np.log((a + 0.5) * even / (b + 0.5 * even))
        return np.sign(r) * np.maximum(0, abs(r) - doubt * np.sqrt(1 / (np.maximum(a, b / even) + 0.5) + 1 / (np.maximum(b, a * even) + 0.5))) * (corpus >= quality.RARE)

    def marked(a, b):
        r = ratio(a, b, quality.MARKED)
        rest = r > -1.5
        return np.where(rest, np.log((a[rest].sum() + 0.5) / a.sum()) - np.log((b[rest].sum() + 0.5) / b.sum()), r)

    assert both.names == names and np.allclose(both.ratios, [ratio(counts[names[0]], counts[n], quality.DOUBT) for n in names[1:]] + [ratio(known, corpus, quality.DOUBT)])
    want = [marked(counts[names[0]], counts[n]) for n in names[1:]] + [ratio(known, corpus, quality.DOUBT)]
    assert model.names == names and np.allclose(model.ratios, want)
    found = np.array([sum(k == n for k in kinds.values()) for n in names])
    assert np.allclose(model.shares, np.append(found / found.sum() * (1 - quality.RAW), quality.RAW))
    weights = {}
    for i, t in texts.items():
        x = np.log(model.shares) - np.concatenate([[0], [(r * bag(t)).sum() for r in want]])
        weights[i] = -(x.max() + np.log(np.exp(x - x.max()).sum()))
    rows = quality.select(docs, labels.union(odd), share=0.5, temperature=2.0, seed=7).collect()
    noise = {r[0]: -np.log(-np.log((((r[1] & (2**64 - 1)) >> 11) + 0.5) / 2**53)) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7))).collect()}
    score = {i: weights[i] + 2.0 * noise[i] for i in weights}
    floor = sorted(score.values(), reverse=True)[round(0.5 * len(score)) - 1]
    for r in rows:
        assert r["log_weight"] == pytest.approx(weights[r["doc_id"]], abs=1e-6) and r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-6)
        assert r["selected"] == (score[r["doc_id"]] >= floor - 1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_held_out_by_language(spark):
    """Of labelled clean rows that the model has not seen, nearly all are selected in every language; of junk and English toxic ones few."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id, 99), 10) < 3").select("doc_id", "quality", "toxic")
    out = quality.scored(docs, labels.join(held, "doc_id", "left_anti"), carry=("doc_id", "lang")).join(held, "doc_id")
    by = {(r["quality"], r["toxic"], r["lang"]): r["p"] for r in out.groupBy("quality", "toxic", "lang").agg(F.avg(F.col("selected").cast("int")).alias("p")).collect()}
    assert all(by[1, 0, lang] >= 0.9 for lang in ("en", "de", "fr", "es")), by
    assert by[0, 0, "en"] < 0.2 and by[1, 1, "en"] < 0.2, by


def test_quality_scores_texts_once(spark):
    docs, labels = labelled(spark, 120)
    rows = quality.select(docs, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and rows.columns == [*docs.columns, "log_weight", "score", "selected"]


def test_raw_text_is_counted_over_every_document(spark):
    """A source without labels, of words that no labelled row has, weighs less than target text."""
    docs, labels = labelled(spark)
    hot = [(10_000 + i, " ".join("zq" + w for w in prose(random.Random(i), 90).split()), "en", "hot", 0) for i in range(450)]
    out = quality.select(docs.union(spark.createDataFrame(hot, DOCS)), labels).select("doc_id", "log_weight").collect()
    known = {r["doc_id"]: r for r in labels.collect()}
    good = [r["log_weight"] for r in out if r["doc_id"] in known and known[r["doc_id"]]["quality"] == 1 and known[r["doc_id"]]["toxic"] == 0]
    odd = [r["log_weight"] for r in out if r["doc_id"] >= 10_000]
    assert len(odd) == 450 and max(odd) < np.quantile(good, 0.01) - 5


def test_mixing(spark):
    docs, labels = labelled(spark)
    weights = {(1, 0): 0.9, (0, 0): 0.06, (1, 1): 0.04}
    rows = mixing.mix(docs, labels, weights).collect()
    p, t, r = np.array([x["posterior"] for x in rows]), np.array([x["tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    totals = (r * t) @ p
    assert (r >= 0).all() and totals / totals.sum() == pytest.approx([0.9, 0.06, 0.04], abs=1e-5)
    assert totals[0] == pytest.approx((t @ p)[0], rel=1e-5)  # the first domain stays as it is
    up = mixing.mix(docs, labels, {(1, 0): 0.2, (0, 0): 0.8, (1, 1): 0.0}, total=1000.0, at_most=False).collect()
    totals = sum(np.array(x["posterior"]) * x["tokens"] * x["rate"] for x in up)
    assert totals == pytest.approx([200, 800, 0], abs=10)  # the classes' posteriors overlap
    assert all(x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in rows)
    assert {x["unmet"] for x in rows} == {rows[0]["unmet"]} and rows[0]["unmet"] < 1e-6
    assert mixing.mix(docs, labels.limit(0), weights).where("rate <> 1 or unmet > 0").count() == 0
    assert {len(x["posterior"]) for x in mixing.mix(docs, labels, weights, least=10_000).collect()} == {1}  # no class has so many labelled rows
    assert mixing.mix(docs.limit(0), labels, weights).count() == 0


def test_rates_of_few_rows_stay_bounded(monkeypatch):
    """Two rows of another domain can't meet the bounds; rounds that lead away from the targets are left out."""
    t, p = np.array([291.0, 116.0]), np.array([[0.0004962595986556329, 4.294840273206957e-146, 2.0026759330401032e-189, 0.9995037404013444], [0.0006094207852211553, 9.1115672026549e-62, 2.7274818906479006e-79, 0.9993905792147789]])

    def total(_, d, history):
        r = mixing.rates(p, np.array(history).reshape(-1, d))
        return p.T @ (p * (t * (r > 0))[:, None]), (t * r) @ p

    monkeypatch.setattr(mixing, "_sum", total)
    history, target, got = mixing.solve(None, 4, np.array(list(mixing.AFTER_FILTER.values())), at_most=True)
    assert mixing.rates(p, history).max() <= 1 and np.abs(got - target).max() <= np.abs(t @ p - target).max()
    assert np.allclose(got, (t * mixing.rates(p, history)) @ p)


def test_unmet_targets_are_told(spark):
    """Documents of one posterior can't meet weights that differ from it: the distance is told, as a share of all tokens."""
    members = spark.createDataFrame([(100, [0.6, 0.4])] * 5, "tokens long, posterior array<double>")
    _, target, got = mixing.solve(members, 2, np.array([0.9, 0.1]), 1000.0)
    assert target.tolist() == [900, 100] and got[0] / got.sum() == pytest.approx(0.6)


def test_markers_by_hand():
    """Only what a class surely has more of is its own; the rest is one bucket, however unlike its parts are."""
    target, other = np.array([400.0, 0, 100, 500, 3]), np.array([10.0, 50, 30, 0, 0])
    ratio = quality.marker_ratio(target, other, np.array([True, True, True, True, False]), 2.0)
    assert ratio[1] == pytest.approx(quality.log_ratio(target, other, 2.0)[1]) and ratio[1] < -1.5
    rest = np.log(1003.5 / 1003) - np.log(40.5 / 90)
    assert np.allclose(ratio[[0, 2, 3, 4]], rest)


def test_memberships_of_a_filtered_table(spark):
    """known: the table before a filter, which leaves too little of the other classes to tell them by."""
    docs, labels = labelled(spark)
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    some = docs.join(good, "doc_id", "left_semi").union(docs.join(good, "doc_id", "left_anti").limit(12))
    own = mixing.mix(some, labels, mixing.AFTER_FILTER, at_most=True, known=docs).collect()
    clean = {r["doc_id"] for r in good.collect()}
    assert np.mean([r["posterior"][0] for r in own if r["doc_id"] in clean]) > 0.9
    assert np.mean([r["copies"] > 0 for r in own if r["doc_id"] in clean]) > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_memberships_held_out_by_language(spark):
    """Of labelled clean rows that the model has not seen, those of each language are taken for clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id, 99), 10) < 3").select("doc_id", "quality", "toxic")
    members = mixing.mix(docs, labels.join(held, "doc_id", "left_anti"), mixing.WEIGHTS, carry=("doc_id", "lang"))
    first = F.avg(F.col("posterior")[0]).alias("p")
    by = {(r["quality"], r["toxic"], r["lang"]): r["p"] for r in members.join(held, "doc_id").groupBy("quality", "toxic", "lang").agg(first).collect()}
    assert all(by[1, 0, lang] >= 0.9 for lang in ("en", "de", "fr", "es")), by
    assert by[0, 0, "en"] < 0.2 and by[1, 1, "en"] < 0.1, by  # seven and five rows


def test_mixing_raises_domains_to_their_weights(spark):
    docs, labels = labelled(spark)
    rows = mixing.mix(docs, labels, {(1, 0): 0.5, (0, 0): 0.4, (1, 1): 0.1}).collect()
    p, t, r = np.array([x["posterior"] for x in rows]), np.array([x["tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    now, totals = t @ p, (r * t) @ p
    assert now[1] / now.sum() < 0.3  # junk (class 1 in order of names) has less than its weight
    assert totals / totals.sum() == pytest.approx([0.5, 0.4, 0.1], abs=1e-4) and totals[0] == pytest.approx(now[0], rel=1e-4)


# -- 5 -------------------------------------------------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    docs = frame(spark, [f"text {i} " * 50 for i in range(500)] + ODD, 4)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fan_in=3, small_bytes=2_000)
    for i in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == i), rows_per_shard=25)
    first = store.manifest()
    assert first["version"] == 4 and len(first["shards"]) >= 20 and sum(s["rows"] for s in first["shards"]) == 510
    reader = store.read()  # of version 4, and not begun yet
    after = store.compact()
    assert after["version"] == 5 and after == store.head()
    after = store.manifest()
    assert len(after["shards"]) < len(first["shards"]) and sum(s["rows"] for s in after["shards"]) == 510
    for back in (store.read(), store.read(version=4), reader):
        assert back.drop("__shard").exceptAll(docs).count() == 0 and docs.exceptAll(back.drop("__shard")).count() == 0
    assert store.read().select("__shard").distinct().count() == len(after["shards"])
    with pytest.raises(sharding.CommitConflict):  # a writer that read an older manifest
        store.commit(first, sharding.Change(set(), []), None)
    assert store.manifest() == after and store.versions() == [1, 2, 3, 4, 5]
    assert store.vacuum() == 0 and store.read(version=4).count() == 510  # an hour's grace
    assert store.vacuum(retain_ms=0) >= len(first["shards"]) - len(after["shards"]) and store.versions() == [5] and store.read().count() == 510
    empty = sharding.shard(docs.limit(0), f"file://{tmp_path}/empty")
    assert empty.read().count() == 0 and empty.manifest()["shards"] == []
    store.append(docs.limit(0))
    assert store.read().count() == 510
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumn("__SHARD", F.lit(1)))


def test_sharding_of_two_writers(spark, tmp_path):
    docs = frame(spark, [f"text {i} " * 50 for i in range(120)] + [None], 2).withColumn("path", F.lit("clash")).union(spark.createDataFrame([(None, None, None, None, None, None)] * 2, f"{DOCS}, path string"))
    root = f"file://{tmp_path}/store"
    one, two = (sharding.ShardStore(spark, root, target_bytes=60_000, fan_in=3, small_bytes=2_000) for _ in range(2))
    one.append(docs, rows_per_shard=10)
    commit, late = sharding.ShardStore.commit, []

    def slow(store, before, shards, schema):  # the other writer comes first, once
        if not late:
            late.append(two.append(docs, rows_per_shard=50))
        return commit(store, before, shards, schema)

    one.commit = slow.__get__(one)
    one.append(docs, rows_per_shard=30)
    assert one.versions() == [1, 2, 3] and one.read().count() == 3 * docs.count()  # neither arrival is lost
    late.clear()
    shards = lambda: [s["path"] for s in one.manifest()["shards"]]

    def merged(store, before, new, schema):  # the other writer merges the same shards
        if not late:
            late.append(two.compact())
        return commit(store, before, new, schema)

    one.commit = merged.__get__(one)
    one.compact()
    assert shards() == [s["path"] for s in two.manifest(late[0]["version"])["shards"]] and one.read().count() == 3 * docs.count()
    folders = {p.name for p in (tmp_path / "store" / "data").iterdir()}
    named = {s["path"].rsplit("/", 2)[-2] for v in one.versions() for s in one.manifest(v)["shards"]}
    assert folders == named  # what was given up is gone
    bad = docs.withColumn("n_chars", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        one.append(bad, rows_per_shard=10)
    assert {p.name for p in (tmp_path / "store" / "data").iterdir()} == named


def test_manifests_share_their_parts(spark, tmp_path, monkeypatch):
    """A commit writes the parts that it changes; numbers and rows are the same by paths and by folders; parts that nothing names go."""
    monkeypatch.setattr(sharding, "PART", 5)
    docs = frame(spark, [f"text {i} " * 50 for i in range(400)] + ODD, 4)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=30_000, fan_in=4, small_bytes=2_000)
    store.append(docs.repartition(1).sortWithinPartitions("doc_id"), rows_per_shard=400)  # one large shard, that stays
    for i in range(6):
        before = store.head()["parts"]
        store.append(docs.where(F.col("doc_id") % 6 == i), rows_per_shard=20)
        parts = store.head()["parts"]
        assert [p["name"] for p in parts[: len(before) - 1]] == [p["name"] for p in before[:-1]] and all(p["n"] <= 5 for p in parts)
    m = store.manifest()
    assert sum(p["n"] for p in m["parts"]) == len(m["shards"]) > 20
    reader = store.read()
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < len(m["shards"])
    both = docs.unionAll(docs)
    by_path = sorted(map(str, store.read().collect()))
    store.named = 0  # as if there were too many shards to name
    assert sorted(map(str, store.read().collect())) == by_path and "BroadcastHashJoin" not in store.read().where("false")._jdf.queryExecution().optimizedPlan().toString()
    for back in (store.read(), reader):
        assert sorted(map(str, back.drop("__shard").collect())) == sorted(map(str, both.collect()))
    assert store.vacuum(retain_ms=0) > 0
    named = {p["name"] for p in store.head()["parts"]}
    assert {x.name for x in (tmp_path / "store" / "_manifests").glob("part-*")} == named
    assert sorted(map(str, store.read().collect())) == by_path


def test_sharding_numbers_are_the_same_in_every_run(spark, tmp_path):
    docs = frame(spark, [f"text {i} " * 50 for i in range(300)], 3)
    got = [sharding.shard(docs, f"file://{tmp_path}/{k}", 20, target_bytes=30_000, fan_in=3, small_bytes=2_000) for k in "ab"]
    assert not got[0].plan(got[0].manifest()["shards"])
    a, b = (s.read().select("doc_id", "__shard").collect() for s in got)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# -- 6 -------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 24))
    x[100:400] = x[100] + rng.standard_normal((300, 24)) * 1e-3
    x[500:540] = x[500]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("inf")] * 24), (9003, [1.0] * 3), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:20]
        own = sorted(got[q])
        assert [a for a, _, _ in own] == list(range(1, 21)) and all(c == pytest.approx(s[v], abs=1e-9) for _, v, c in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert set(got) == set(range(0, 4000, 20)) and hits / (200 * 20) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).orderBy("rank").collect()
    assert len(few) == 4 and ann.nearest(df.limit(0), df).count() == 0


# -- 7 -------------------------------------------------------------------------------------------------------------


def jaccard(texts, n, num, den):
    s = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in s:
        for j in range(i):
            both = len(s[i] & s[j])
            if both and den * both >= num * (len(s[i]) + len(s[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), top(i)) for i in s}


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, n, num):
    rnd = random.Random(7)
    texts = list(ODD)
    for _ in range(50):
        words = prose(rnd, rnd.randint(5, 150)).split()
        for _ in range(rnd.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                own[rnd.randrange(len(own))] = prose(rnd, 1)
            texts.append((" " if rnd.random() < 0.8 else "\n").join(own).upper() if rnd.random() < 0.2 else " ".join(own))
    hot = prose(rnd, 120).split()
    for _ in range(60):  # one large group
        own = list(hot)
        own[rnd.randrange(120)] = "x"
        texts.append(" ".join(own))
    rnd.shuffle(texts)
    docs = frame(spark, texts).withColumn("name", F.lit("clash")).withColumn("component_id", F.lit(0))
    want = jaccard(texts, n, num, 100)
    for slice_rows in (2048, 20):  # columns whole, and the hot group's cut into slices that meet in pairs
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(docs, n, num, 100, slice_rows).collect()} == want


def test_sets_with_columns_of_their_own_are_cleared(spark):
    rnd = random.Random(17)
    texts = [prose(rnd, 200, 40_000) for _ in range(120)]
    texts += [texts[3], texts[4] + " x", " ".join(texts[5].split()[:-3] + ["y"] * 3), "few words"]
    docs = frame(spark, texts, 5)
    rows = docs.select("doc_id", "text").mapInArrow(ngram_join._scan(3), "doc_id long, n_shingles long, name long").cache()
    left = {r["name"] for r in ngram_join.open_names(rows, docs.select("text"), 3, 90, 100, 4).collect()}
    ids = {r["doc_id"] for r in rows.collect() if r["name"] in left}
    assert {4, 121, 5, 122} <= ids and 3 not in ids and len(ids) < 20  # near copies stay; copies of one set are one row


def test_tested_columns_go_in_bounded_packs():
    """However many sets a task has, at once it packs the columns that it holds at most and one set's; copies of a set go once, whatever batch they are in."""
    import pyarrow as pa

    draw = random.Random(5)
    texts = [" ".join(str(draw.randrange(10**9)) for _ in range(1000)) for _ in range(1200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 600] + texts[:50])], ["text"]) for i in (0, 600)]
    sent, rows = 0, collections.Counter()
    for out in ngram_join._tested(5, 0.5, 16)(iter(batches)):
        packs = [np.frombuffer(x, np.uint32) for x in out.column(3).to_pylist()]
        assert sum(map(len, packs)) <= (1 << 18) + 1000
        sent += sum(map(len, packs))
        for names, counts in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            for name, n in zip(np.frombuffer(names, np.int64).tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                rows[name] += n
    want = {ngram_join.digest_of(s): int((ngram_join.mix64(s, 21) <= np.uint64(2**63)).sum()) for s in text_hash.sets(pa.array(texts), 5)}
    assert rows == want and sent == sum(want.values())


def test_jaccard_join_of_nothing(spark):
    assert ngram_join.jaccard_join(frame(spark, ["a"]).limit(0)).count() == 0
    rows = ngram_join.jaccard_join(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(["(None, 2, 3)", "(3, 2, 3)", "(3, 2, 3)", "(None, 0, None)"])


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(8).integers(0, 2**63, 20_000, dtype=np.int64).view(np.uint64))
    values = np.arange(len(keys), dtype=np.uint32)
    h = line_dedup.PerfectHash.of(line_dedup.PerfectHash.build(keys, values).parts())
    assert np.array_equal(np.sort(h.index(keys)), np.arange(len(keys))) and np.array_equal(h.get(keys), values)
    assert (h.get(keys + np.uint64(1)) > 0).mean() < 1e-3
    assert len(line_dedup.PerfectHash.build(keys[:0], values[:0]).get(keys[:3])) == 3


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(spark, least):
    rnd = random.Random(8)
    lines = [prose(rnd, rnd.randint(1, 4)) for _ in range(60)] + ["", " ", "\x0b", "ab", " x"]
    texts = list(ODD) + ["\n".join((" " * rnd.randint(0, 2) + x).upper() if rnd.random() < 0.3 else x for x in rnd.choices(lines, k=rnd.randint(0, 9))) for _ in range(120)]
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    bad = {k for k, c in seen.items() if c >= 10 and len(k.decode()) >= least}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, texts).withColumn("n_lines", F.lit("x")), 10, least).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in bad]
        assert got[i] == ("\n".join(kept), len(own), len(own) - len(kept))
    assert bad and line_dedup.dedup_lines(frame(spark, texts).limit(0)).count() == 0
    clash = frame(spark, texts).selectExpr("doc_id", "text", "lang AS owner", "source AS Hot", "n_chars AS r", "n_chars AS __owner")
    out = line_dedup.dedup_lines(clash, 10, least)
    assert out.columns == [*clash.columns, "n_lines", "n_dropped"] and {r["doc_id"]: r["text"] for r in out.collect()} == {i: v[0] for i, v in got.items()}
    assert {tuple(r)[2:6] for r in out.collect()} == {tuple(r)[2:6] for r in clash.collect()}


# -- 9 -------------------------------------------------------------------------------------------------------------


def removed(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((len(raw), sum(mark), bytes(x for x, m in zip(raw, mark, strict=True) if not m), len(re.findall(rb"\x01+", bytes(mark)))))
    return out


@pytest.mark.parametrize("length", [100, 24])
def test_substrings(spark, length):
    rnd = random.Random(9)
    passages = [prose(rnd, rnd.randint(5, 60)) for _ in range(8)]
    texts = list(ODD)
    for _ in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else prose(rnd, rnd.randint(1, 50)) for _ in range(rnd.randint(1, 5))]
        texts.append("é ".join(parts))
    texts += [texts[20], texts[20], "ab" * 400, "x" * 333, passages[0][:99]]
    docs = frame(spark, texts, 5).withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(docs, length).collect()}
    for i, (size, gone, kept, runs) in enumerate(removed(texts, length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"]), len(r["spans"])) == (size, gone, kept, runs), i
    assert suffix_dedup.dedup_substrings(docs.limit(0), length).count() == 0


def test_substrings_of_repeated_ids(spark):
    t = "abc " * 60 + "unlike this one"
    rows = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.dedup_substrings(rows).collect())
    one = removed([t, t, t], 100)
    assert got == sorted([(0, one[0][1]), (1, one[1][1]), (1, one[2][1]), (2, 0)])


@pytest.mark.parametrize("slice_bytes", [2_000, 9_000, 1 << 20])
def test_substrings_across_slices(spark, tmp_path, slice_bytes):
    """One batch that spans several slices: a repeat may have its first copy in another slice of either scan."""
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(20, 90), 40_000) for _ in range(50)]
    texts += [*texts[::-1], prose(rnd, 30) + texts[20][:150] + prose(rnd, 30)]  # copies at all distances
    frame(spark, texts, 1).sortWithinPartitions("doc_id").write.parquet(f"file://{tmp_path}/docs")  # files: few splitters leave grams closed
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(docs, 100, slice_bytes).collect()}
    for i, (_, gone, kept, runs) in enumerate(removed(texts, 100)):
        assert (got[i]["n_removed"], bytes(got[i]["kept"]), len(got[i]["spans"])) == (gone, kept, runs), i


def test_multikey_order():
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, k, 3000) for k in (3, 5, 2000))
    assert np.array_equal(suffix_dedup.multikey_order(a, b, c), np.lexsort((c, b, a)))


# -- 10 ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary())
    tok.no_truncation()
    tok.no_padding()
    rnd = random.Random(10)
    texts = [*ODD, "aaaaaaa aa aaaaaaaaaaaaa", "İstanbul ΣΑΣ ﬁ 日本語 한글", "x­Ёж<|startoftext|><|end", "don't DON'T we'll 3.14 ½²", *[prose(rnd, 50).title() + "!?" for _ in range(30)]]
    docs = frame(spark, texts)
    ids = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_digests(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == text, t
        assert digests[i]["n_tokens"] == len(want) and digests[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and digests[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_encodes_a_word_once_for_all_its_pieces(monkeypatch):
    """Whatever stands beside a word, later blocks take it from the memo; cleared memos and texts beyond Latin-1 change no result."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["word, Word", "(word) word's", "\u00e9t\u00e9 \u201cword\u201d \u00c3\u00a9 word", "a\tword <|endoftext|>word<|startoftext|> e\u0301", "aaaa aaaaa aaa 'll'll ''s", "\u00b2\u00bd \u00c3\u00a9 caf\u00e9's\n\nword", None]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1)
    for most in (bpe.MEMO_WORDS, 2):
        monkeypatch.setattr(bpe, "MEMO_WORDS", most)
        model, asked = bpe.WordBPE(path), []
        plain = model.encode_words
        monkeypatch.setattr(model, "encode_words", lambda words, plain=plain, asked=asked: asked.extend(words) or plain(words))
        for text, (block, memo) in zip(texts, bpe.encode_blocks(model, iter(texts), True), strict=True):
            want = tok.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(b"".join(memo[w][0] for w in block[0]), "<u4").tolist() == want, text
            assert b"".join(memo[w][1] for w in block[0]).decode()[1:] == tok.decode(want, skip_special_tokens=False), text
        if most > 2:
            assert asked.count("word") <= 2  # as a word in Latin-1, and once in the byte alphabet


def test_texts_longer_than_a_block(spark):
    """One text above every block of op3, op7, op8, op9 and op10, beside a short one."""
    from tokenizers import Tokenizer

    rnd = random.Random(20)
    long = "\n".join(prose(rnd, 90, 3000) for _ in range(4200)) + "\n" + "x" * 5000  # some 2.3 million characters
    assert len(long) > 2 << 20
    texts = [long, "short one here", long[: 2 << 20] + " end"]
    docs = frame(spark, texts, 2)
    tok = Tokenizer.from_file(bpe.vocabulary())
    tok.no_truncation()
    tok.no_padding()
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    kept = {r["doc_id"]: (r["n_removed"], len(r["spans"])) for r in suffix_dedup.dedup_substrings(docs, 100, 1 << 20).collect()}
    assert kept == {0: (4999, 1), 1: (0, 0), 2: (2 << 20, 1)}  # the run of x repeats itself
    assert {r["doc_id"]: r["n_shingles"] for r in ngram_join.jaccard_join(docs, 3, 90, 100).collect()} == {i: v[0] for i, v in jaccard(texts, 3, 99, 100).items()}
    assert [r["n_dropped"] for r in line_dedup.dedup_lines(docs, 2).orderBy("doc_id").collect()] == [sum(x in set(texts[2].split("\n")) for x in long.split("\n")), 0, sum(x in set(long.split("\n")) for x in texts[2].split("\n"))]
    assert quality.select(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")).count() == 3
