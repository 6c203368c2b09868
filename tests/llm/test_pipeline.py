"""The corpus pipeline, stage by stage, against brute force."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundloom.llm import langid, pii, quality, simhash
from groundloom.llm.common import shared_table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared_table(stage(spark, out[-1], FOLDER), name.replace(" ", "-")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns


def test_quality(spark, stages):
    rules = quality.learn(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert ids(stages[1]) == sorted(r.row.doc_id for r in quality.judge(stages[0], rules).where("kept").collect())
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").join(stages[0], "doc_id").where("size(split(text, ' ')) >= 12")
    kept = set(ids(stages[1]))
    assert sum(r.doc_id in kept for r in good.collect()) >= 0.98 * good.count()


def test_language(stages):
    found = langid.identify(stages[1], langid.train(stages[1]))
    assert ids(stages[2]) == sorted(r.doc_id for r in found.where("lang_pred <> 'und' and score >= 0.5").collect())


def test_near_copies(stages):
    """No two texts that stay are of similarity 0.8, and every text that goes has a chain of copies to one that stays."""
    docs = {r.doc_id: set(simhash.shingles(r.text, 5)) for r in stages[2].collect()}
    kept = set(ids(stages[3]))
    near = collections.defaultdict(set)
    by = collections.defaultdict(list)
    for i, s in docs.items():
        for x in s:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    j = len(docs[a] & docs[b]) / len(docs[a] | docs[b])
                    if j >= 0.8:
                        near[a].add(b), near[b].add(a)
                    assert j < 0.8 or not {a, b} <= kept
    for i in docs.keys() - kept:
        reach, front = {i}, [i]
        while front:
            front = [b for a in front for b in near[a] - reach]
            reach.update(front)
        assert reach & kept


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.text == pii.redacted(before[r.doc_id]) and not pii.base_spans(r.text) and r.n_chars == len(r.text)


def test_packing(stages):
    per = {r.doc_id: (r.n, r.t) for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert sorted(per) == ids(stages[4]) and all(n == t for n, t in per.values())


def test_run(spark, stages):
    assert ids(corpus_pipeline.run(spark, FOLDER)) == ids(stages[5])


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", None, "a", 0), (2, "one two three four five six seven eight nine ten eleven mail a@b.co", "en", "a", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("row", F.lit("x"))
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data, want in ((docs, 1), (docs.where("false"), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            data = shared_table(stage(spark, data, str(tmp_path)), "odd")
            assert data.columns == docs.columns
        assert data.count() == want
        assert corpus_pipeline.STAGES[-1][1](spark, data, str(tmp_path)).count() == want
