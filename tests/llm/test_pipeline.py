"""The pipeline's stages against plain Python on a small table."""

import os

import pytest
from pyspark.sql import functions as F

from spanforge.llm import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    from spanforge.llm import common

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = docs
    for i, (_, stage) in enumerate(c.STAGES):
        out = common.save(stage(spark, at, DIR), "t")
        rows = out.collect()
        if i < 4:
            assert out.columns == c.COLUMNS and {r["doc_id"] for r in rows} <= set(texts)
        if i == 2:  # one document of each group
            import test_ops

            before = sorted((r["doc_id"], r["text"]) for r in at.collect())
            groups = test_ops.jaccard([t for _, t in before], 5, 80, 100)
            assert sorted(r["doc_id"] for r in rows) == [before[k][0] for k, (_, top) in groups.items() if top == k]
        at = out
    assert at.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    """Empty tables end as empty tables; null texts and ids and repeated ids go through, and one row of a group of copies stays."""
    import corpus_pipeline as c

    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    for name, rows in (("empty", docs.limit(0)), ("odd", spark.createDataFrame([(None, "a b c d e f g", None, None, None), (3, "a b c d e f g", "en", "s", 1), (3, "a b c d e f g", "en", "s", 1), (3, "other words that are not in there", "en", "s", 1), (None, None, None, None, None), (4, "", "en", "s", 0)], docs.schema))):
        for k, (table, own) in enumerate({"documents": rows, "labels": labels.limit(0) if name == "empty" else labels.unionByName(labels.limit(3)).union(spark.createDataFrame([(None, None, None)], labels.schema))}.items()):
            own.write.parquet(f"file://{tmp_path}/{name}/{table}.parquet")
        out = c.run(spark, f"file://{tmp_path}/{name}").collect()
        if name == "empty":
            assert out == []
        else:
            near = c.ngram_jaccard_join(spark, rows, "").collect()
            assert sorted(str(r["text"]) for r in near) == ["", "None", "a b c d e f g", "other words that are not in there"]
            assert next(r["doc_id"] for r in near if r["text"] == "a b c d e f g") is None  # ids sort nulls first


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_stages_keep_clean_documents(spark):
    """Of labelled clean rows of every language, the quality stage keeps nine in ten, and the mixing stage 95 % of these; of toxic ones less is left."""
    import corpus_pipeline as c
    from spanforge.llm import common

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    kept = common.save(c.quality_classifier(spark, docs, d), "t")
    mixed = common.save(c.mixing_stage(spark, kept, d), "t")

    def count(rows, toxic):
        own = labels.where(f"quality = 1 and toxic = {toxic}")
        return {r["lang"]: r["n"] for r in rows.join(own, "doc_id").groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}

    before, after, end = (count(x, 0) for x in (docs, kept, mixed))
    for lang, n in before.items():
        assert after[lang] >= 0.9 * n and end[lang] >= 0.95 * after[lang], (lang, before, after, end)
    assert sum(count(mixed, 1).values()) < sum(count(kept, 1).values()) < 0.3 * sum(count(docs, 1).values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_mixing_does_not_multiply_texts_without_tokens(spark):
    """Where few rows are left that can't meet the bounds, a null text stays one row."""
    import corpus_pipeline as c

    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    few = docs.where("doc_id in (881, 7111)").union(spark.createDataFrame([(-1, None, None, None, None)], docs.schema))
    assert c.mixing_stage(spark, few, d).where("doc_id = -1").count() == 1


def test_stages_send_bounded_batches(spark):
    """Long texts reach Python in batches of some 8 MiB, not of 64; a bound that the session has is left alone."""
    import corpus_pipeline as c
    import pyarrow as pa

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 350_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    c.bpe_encoding_and_decoding(spark, docs, DIR)
    assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 10 << 20
    spark.conf.set(bound, "3m")
    c.bpe_encoding_and_decoding(spark, docs, DIR)
    assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5 << 20
    spark.conf.unset(bound)


def test_results_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, DIR)
        rel = con.execute(sql)
        order = [[d[0] for d in rel.description].index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in order) for r in rel.fetchall()), name


def test_contract_columns(spark):
    want = {
        "op2_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"], "op6_approximate_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op7_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"], "op8_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op9_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op10_bpe_encoding_and_decoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op11_url_filters": ["page_id", "host", "path", "rule", "verdict"], "op12_ball_kmeans": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    }
    for name, columns in want.items():
        assert registry.queries()[name](spark, DIR).columns == columns
