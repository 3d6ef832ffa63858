from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from terraspan.llm import jaccard_join, toxicity
from terraspan.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before
        before = docs.count()
    found = jaccard_join.near_duplicates(docs)
    assert found.where("doc_id <> component_id").count() == 0
    pieces = corpus_pipeline.pack(spark, docs, DIR)
    assert pieces.select("doc_id").distinct().count() == before


def test_toxicity_stage_takes_what_the_model_rejects(spark):
    docs = table(spark, DIR, "documents")
    model = toxicity.fit_labels(docs, table(spark, DIR, "labels"))
    bad = {r.doc_id for r in toxicity.predict(docs, model).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DIR).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - bad


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_run_keeps_one_stage(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"), "terraspan")
    before = {*root.glob("pipeline-*")}
    pieces = corpus_pipeline.run(spark, DIR)
    (own,) = {*root.glob("pipeline-*")} - before
    assert [p.name for p in own.iterdir() if p.is_dir()] == ["secrets"] and pieces.count() > 0


def test_odd_rows_and_columns(spark):
    """Rows without ids, repeated rows, null and empty texts, and columns whose names the operators use."""
    docs = table(spark, DIR, "documents").withColumns({"component_id": F.lit(1), "ratio": F.lit("r"), "n_tokens": F.lit(2.0), "set_hash": F.lit("s")})
    longest = docs.where("text is not null and doc_id % 5 = 1").orderBy(F.desc("n_chars")).limit(3)
    docs = docs.unionByName(longest).unionByName(longest.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(4).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    turned = F.array_join(F.reverse(F.split("text", " ")), " ")  # like no other text
    docs = docs.unionByName(longest.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat(turned, F.lit(" password = hunter2hunter2"))})).repartition(5).cache()
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR).cache()
        assert now.columns == docs.columns, name
        if name == "near_duplicates":
            assert now.groupBy("text").count().where("count > 1").count() == 0
    assert now.where("doc_id is null").count() > 0 and now.where("text like '%hunter2hunter2%'").count() == 0
    assert corpus_pipeline.pack(spark, now, DIR).agg(F.sum("length")).first()[0] > now.count()


def test_near_duplicate_stage_against_brute_force(spark):
    docs = table(spark, DIR, "documents").where("doc_id is not null")
    own, up = {r.doc_id: set() for r in docs.collect()}, {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        own[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a in own:
        for b in own:
            if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, DIR).collect()} == {a for a in own if top(a) == a}


def test_empty(spark):
    docs = table(spark, DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
