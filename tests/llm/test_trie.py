"""The prefix trie against one of nested dictionaries, odd rows, many batches and chunks, fat binary search."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.llm import queries, trie
from groundloom.plans.verify import differences, duck

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        words = len(trie_words(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(node), -1 if not node else min(members[node[:-1]]), len(m), len(kids.get(node, [])), leaves[node], saved[node], sha(ends.get(node, []))) for node, m in members.items()
    )


def trie_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text)


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    r = np.random.default_rng(17)
    rows = []
    for c in range(70):
        for t in range(int(r.integers(0, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], " ".join(["yes"] * int(r.integers(1, 3)))))
    rows += [(c, t, "user", "same words here") for c in range(200, 245) for t in range(3)]  # copies
    rows += [(300 + c, t, "user", f"step {t}") for c in range(20) for t in range(c + 1)]  # each the beginning of the next
    rows += [(400, t, "user", "long " * (t % 3)) for t in range(60)] + [(420, t, "user", "long " * (t % 3) if t < 55 else "x") for t in range(60)]
    rows += [(None, 1, "user", "lost"), (500, None, None, None), (500, None, "user", "b c"), (500, 1, "user", None), (501, 2, "user", "twice"), (501, 2, "user", "twice"), (-7, 0, "user", " "), (-21, 1, "a\x0b", "\xa0é x")]
    return rows


@pytest.mark.parametrize("first, chunk", [(8, 4096), (2, 4)])
def test_against_dictionaries(spark, made, first, chunk):
    odd = {c: F.lit(7) for c in ("rep", "e", "at", "words", "chunk", "len", "hash", "n", "part", "k", "depth", "base")}
    got = trie.prefix_trie(spark.createDataFrame(made, COLUMNS).withColumns(odd), first, chunk)
    assert rows_of(got) == brute(made)


def test_small_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], COLUMNS)).collect() == []
    # conversation 2 takes its first turns from conversation 0, which is absent, and has too few of its own: it has no turns
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, COLUMNS))) == brute(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_fat_binary_search(spark, made):
    """Exit nodes by handles are those that a walk over all edges finds."""
    turns, convs = trie.rebuilt(trie.numbered(spark.createDataFrame(made, COLUMNS)))
    stored, ends = trie.paths(turns, convs, 4)
    half = ends.where("conv_id % 2 = 0")
    edges = trie.build(stored, half, 3, 4)
    longest = ends.agg(F.max("len")).first()[0]
    got = {r.conv_id: (r.e, tuple(r.eh), r.rep is None) for r in trie.locate(ends, trie.with_handles(edges, stored, 4), stored, longest, 4).collect()}
    at = {}
    for r in stored.collect():
        at.setdefault(r.conv_id, {})[r.chunk] = [tuple(h) for h in r.hashes]
    path = {c: [h for k in sorted(v) for h in v[k]] for c, v in at.items()}
    for c, own in path.items():
        e, eh, inside = 0, (0, 0), True
        for x in sorted(edges.collect(), key=lambda x: x.a):
            if x.a == e and tuple(x.ah) == eh and x.a < len(own) and path[x.rep][x.a] == own[x.a] and inside:
                e, eh = x.e, tuple(x.eh)
                inside = x.e <= len(own) and own[x.e - 1] == eh
        assert got[c] == (e, eh, inside), c


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_prefix_trie"](spark, folder).toPandas().astype({"parent_conv_id": "Int64"})
    assert differences(got, duck(folder).execute(queries.ORACLES["op11_prefix_trie"]).df()) is None
