"""What Python workers hold after their tasks."""

import os
import re
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from groundloom.llm import common, packing, simhash, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_tasks_drop_what_others_remember():
    coder = words.chunk_ids(WORD_BPE)
    ids = coder.encode(["a few words, twice a few"])
    assert list(common.lean(lambda x: x, WORD_BPE)(iter([1, 2]))) == [1, 2] and coder.known and coder.parts
    assert list(common.lean(lambda x: x)(iter([1, 2]))) == [1, 2] and not coder.known and not coder.parts
    assert words.chunk_ids(WORD_BPE) is coder and coder.encode(["a few words, twice a few"]) == ids


def test_workers_give_memory_back(spark, monkeypatch):
    """Once packing and near copies are done with 8 MB of text a task, a worker holds little more than modules and a vocabulary."""

    def held(batches):
        for _ in batches:
            text = Path("/proc/self/smaps_rollup").read_text()
            yield pd.DataFrame({"pid": [os.getpid()], "mb": [sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", text))) / 1024]})

    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS_OF", "this test")  # workers of its own, in which no other test ran
    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_400)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(20_000)).cast("string"))), " ")
    docs = common.shared_table(spark.range(0, 8_000, 1, 8).select(F.col("id").alias("doc_id"), texts.alias("text")), "texts")
    packing.token_table(docs, WORD_BPE, 1)
    simhash.sketches(docs).write.format("noop").mode("overwrite").save()
    found = spark.range(0, 64, 1, 64).mapInPandas(held, "pid long, mb double").groupBy("pid").agg(F.max("mb").alias("mb")).collect()
    assert max(x.mb for x in found) < 95
