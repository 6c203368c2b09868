"""Positional index: occurrences and proximity against plain scans, odd rows, several passes, hot terms."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.llm import phrases, queries
from groundloom.plans.verify import differences, duck

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(docs, items, window=10, near=20):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    sought = {(None if i is None else str(i), tuple(w[k : k + window])) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - window + 1))}
    out = []
    for doc, text in docs:
        w = cut(text)
        hit, found, close = set(), set(), set()
        for item, x in sought:
            at = [k for k in range(len(w) - len(x) + 1) if tuple(w[k : k + len(x)]) == x]
            hit.update(k + d for k in at for d in range(len(x)))
            if at and item is not None:
                found.add(item)
            if item is not None and any(set(x) <= set(w[k : k + near]) for k in range(len(w))):
                close.add(item)
        spans = [k for k in sorted(hit)]
        out.append((str(doc), len(w), tuple(spans), tuple(sorted(found)), tuple(sorted(close))))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, tuple(k for s in r.spans for k in range(s.start, s.till)), tuple(r["items"]), tuple(r.near_items)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(11)
    pool = np.array(["the", "The", "de", "é", "ab9", "x", "yy", "zzz", "q", "w1", "中文"])
    text = lambda n: "".join(a + b for a, b in zip(r.choice(pool, n), r.choice([" ", ", ", "\n", "-"], n)))
    items = [(k, text(int(r.integers(1, 14)))) for k in range(25)] + [(3, "the the the"), (None, "x yy zzz q"), (90, None), (91, ""), (92, "--"), (93, "q w1 " * 8)]
    docs = [(k, text(int(r.integers(0, 90)))) for k in range(60)]
    docs += [(200 + k, text(12) + items[k][1] + text(9)) for k in range(25)] + [(300, None), (301, ""), (None, "x yy zzz q"), (302, "x yy zzz q"), (302, "x yy zzz q"), (303, "THE the-The " * 400 + "q w1 " * 50)]
    return docs, items


@pytest.mark.parametrize("window, near, most", [(10, 20, 10**6), (3, 5, 10**6), (4, 63, 7)])
def test_against_plain_scan(spark, made, window, near, most):
    docs, items = made
    odd = {c: F.lit(7) for c in ("term", "block", "postings", "docs", "items", "item", "number", "n_words")}
    index = phrases.index(spark.createDataFrame(docs, "doc_id long, text string").withColumns(odd).repartition(3))
    got = phrases.matches(index, spark.createDataFrame(items, "item_id long, text string").withColumns(odd), window, near, most)
    assert rows_of(got) == brute(docs, items, window, near)


def test_empty_tables(spark, made):
    docs = spark.createDataFrame(made[0], "doc_id long, text string")
    items = spark.createDataFrame(made[1], "item_id long, text string")
    assert phrases.matches(phrases.index(docs.where("false")), items).collect() == []
    assert {(r.n_words, len(r.spans)) for r in phrases.matches(phrases.index(docs), items.where("false")).collect()} == {(len(WORD.findall((t or "").translate(LOWER))), 0) for _, t in made[0]}


def test_many_blocks_and_long_texts(spark, monkeypatch):
    """A phrase at both ends of a long text, texts over several blocks of one task, none over a border of documents."""
    item = " ".join(f"w{k}" for k in range(12))
    docs = [(99, item + " filler" * 400000 + " " + item)] + [(k, ("common " * 3000 + " ".join(f"w{j}" for j in range(6)))) for k in range(40)]
    index = phrases.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert index.where("term IS NULL").count() > 1
    got = {r.doc_id: r for r in phrases.matches(index, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert [tuple(s) for s in got["99"].spans] == [(0, 12), (400012, 400024)] and got["99"]["items"] == ["1"]
    assert all(not got[str(k)].spans for k in range(40))


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_decontamination"](spark, folder).toPandas()
    assert differences(got, duck(folder).execute(queries.ORACLES["op13_decontamination"]).df()) is None
    assert got["contaminated"].any() and not got["contaminated"].all()
