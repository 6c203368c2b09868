"""A prefix trie of conversations as a z-fast trie in tables.

A conversation is a path of turns and an end mark; ``paths`` stores, for every depth, a 128-bit hash of the turns up to there and the words
so far, in rows of ``CHUNK`` depths, so that no conversation is too long for a row or a task.

``build`` keeps the compacted trie as a table of edges: a node (the depth of its extent and the hash there), its parent, and one
conversation that runs through it. A node's handle is the prefix of its extent whose depth is the 2-fattest number of the edge, the one
divisible by the highest power of two. Conversations come in batches:

1. ``locate`` finds each one's exit node in the trie by fat binary search: at most log2(longest)+1 look-ups of (depth, hash) among the handles.
2. The place where it leaves the exit edge is the first different hash beside the conversation that the edge was made from.
3. Of all conversations that leave at one place with one next turn, one drawn by a hash becomes a new leaf, after edges are cut at the
   places where some leave. The others now leave on that new leaf's edge: back to 2. The drawn one shares more than the next turn with a
   good part of the others, so rounds grow with the logarithm of the number of conversations, not with depth. Equal ones drop out.

``nodes`` adds up each compacted node's subtree by doubling the pointers to ancestors, and expands edges to a row for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.llm.common import shared_table
from groundloom.session import cut_lineage

#: Depths in one stored row.
CHUNK = 4096
#: The first batch holds one conversation in so many; the second one the others.
FIRST_BATCH = 8
WORDS = r"[^\x20\x09-\x0D]+"
HASH = "struct<u:bigint,v:bigint>"
ROOT = f"CAST(named_struct('u', 0L, 'v', 0L) AS {HASH})"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place from 1 by turn, null first, then role and text), turns (of its conversation), tu and tv (hash of role and text), words.

    Null roles and texts are empty; rows without conv_id are left out. A conversation of very many turns is numbered in several tasks.
    """
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    size = F.char_length("text").cast("string")
    rows = shared_table(
        rows.select(
            "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
            F.xxhash64(F.lit("a"), "role", "text").alias("tu"), F.xxhash64("text", size, "role", F.lit("b")).alias("tv"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
        ),
        "turns",
    )
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("turns"))
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    return rows.withColumn("k", F.row_number().over(inside)).join(sizes, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("k")).alias("k"), "turns", "tu", "tv", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 20 in front of its own after the first h; h is crc32(c) % 4.

    Gives turns (conv_id, depth from 1, tu, tv, words) and conversations (conv_id, n turns, none included).
    """
    cid = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("turns").alias("own")).select(
        "conv_id", "own", (cid - cid % 20).alias("base"), (F.crc32(cid.cast("string").cast("binary")) % 4).alias("h")
    )
    based = convs.where("conv_id = base").select("base", F.col("own").alias("there"))
    plan = convs.join(based, "base", "left").withColumn("shared", F.least("h", F.coalesce("there", F.lit(0))))
    plan = shared_table(plan.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "plan")
    own = turns.join(plan.select("conv_id", "h", "shared"), "conv_id").where("k > h").select("conv_id", (F.col("shared") + F.col("k") - F.col("h")).alias("depth"), "tu", "tv", "words")
    first = turns.where((F.col("k") <= 3) & (cid % 20 == 0)).select(cid.alias("base"), F.col("k").alias("depth"), "tu", "tv", "words")
    heads = plan.where("shared > 0").select("conv_id", "base", "shared").join(first, "base").where("depth <= shared").select("conv_id", "depth", "tu", "tv", "words")
    return own.unionByName(heads), plan.select("conv_id", "n")


def paths(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Stored prefix hashes: (conv_id, chunk, words_before, hashes, words) and conversations (conv_id, len, hash, words).

    ``len`` counts the end mark. The hash of a prefix is the exclusive or of its turns' hashes with their depths.
    """
    end = convs.select("conv_id", (F.col("n") + 1).alias("depth"), F.lit(1).cast("long").alias("tu"), F.lit(2).cast("long").alias("tv"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("end"))
    rows = turns.withColumn("end", F.lit(False)).unionByName(end)
    rows = rows.select(
        "conv_id", "depth", F.floor((F.col("depth") - 1) / chunk).cast("long").alias("chunk"), F.xxhash64("depth", "tu", "end", "tv").alias("u"), F.xxhash64("tv", "end", "tu", "depth").alias("v"), "words", "end"
    )
    up_to = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "depth", *[F.expr(f"bit_xor({c})").over(up_to).alias(c) for c in "uv"], F.sum("words").over(up_to).alias("words"), "end")
    item = F.struct("depth", "u", "v", "words")
    parts = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("at"), F.max("end").alias("last"))
    final = F.element_at("at", -1)
    parts = cut_lineage(parts.withColumn("total", F.struct(final["u"].alias("u"), final["v"].alias("v"), final["words"].alias("words"))))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv_id", "chunk", *[F.coalesce(F.expr(f"bit_xor(total.{c})").over(earlier), F.lit(0)).alias(f"{c}0") for c in "uv"], F.coalesce(F.sum("total.words").over(earlier), F.lit(0)).alias("words_before"))
    whole = parts.join(before, ["conv_id", "chunk"])
    hashes = F.transform("at", lambda x: F.struct(x["u"].bitwiseXOR(F.col("u0")).alias("u"), x["v"].bitwiseXOR(F.col("v0")).alias("v")))
    words = F.transform("at", lambda x: x["words"] + F.col("words_before"))
    stored = shared_table(whole.select("conv_id", "chunk", "words_before", hashes.alias("hashes"), words.alias("words"), "last"), "paths")
    ends = stored.where("last").select("conv_id", (F.col("chunk") * chunk + F.size("hashes")).alias("len"), F.element_at("hashes", -1).alias("hash"), F.element_at("words", -1).alias("words"))
    return stored.drop("last"), ends


def _with_hash(rows: DataFrame, stored: DataFrame, of: str, depth: Column, out: str, chunk: int) -> DataFrame:
    """``rows`` with the prefix hash of conversation ``of`` at ``depth`` (null where it has none)."""
    asked = rows.withColumn("_d", depth).withColumn("_c", F.floor((F.col("_d") - 1) / chunk).cast("long"))
    at = stored.select(F.col("conv_id").alias("_of"), F.col("chunk").alias("_k"), F.col("hashes").alias("_h"))
    got = asked.join(at, (F.col(of) == F.col("_of")) & (F.col("_c") == F.col("_k")), "left")
    return got.withColumn(out, F.get("_h", (F.col("_d") - 1 - F.col("_c") * chunk).cast("int"))).drop("_d", "_c", "_of", "_k", "_h")


def _fattest(a: Column, b: Column) -> Column:
    """The number of (a, b] that the highest power of two divides; null where there is none."""
    bits = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.when(a < b, b - b % F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def with_handles(edges: DataFrame, stored: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges with ``f`` and ``handle`` (depth and hash of the handle) and ``top`` (hash of the first turn below the parent)."""
    rows = edges.withColumn("f", _fattest(F.col("a"), F.col("e")))
    rows = _with_hash(rows, stored, "rep", F.col("f"), "handle", chunk)
    return _with_hash(rows, stored, "rep", F.col("a") + 1, "top", chunk)


def locate(convs: DataFrame, handled: DataFrame, stored: DataFrame, longest: int, chunk: int = CHUNK) -> DataFrame:
    """The exit node of each conversation: conv_id, len, hash, rep, e, eh of its edge; ``rep`` null where it leaves at the node (e, eh) itself.

    Conversations that are in the trie already have the leaf itself as (e, eh) and ``rep`` null; e = len tells.
    """
    keys = handled.select(F.col("f").alias("_f"), F.col("handle").alias("_handle"), F.col("e").alias("_e"), F.col("eh").alias("_eh"), F.col("rep").alias("_rep"))
    zero = F.lit(0).cast("long")
    s = convs.select("conv_id", "len", "hash", zero.alias("lo"), F.col("len").alias("hi"), zero.alias("e"), F.expr(ROOT).alias("eh"), F.lit(None).cast("long").alias("rep"))
    for step in range(longest.bit_length()):
        s = _with_hash(s.withColumn("probe", _fattest(F.col("lo"), F.col("hi"))), stored, "conv_id", F.col("probe"), "seen", chunk)
        s = s.join(keys, (F.col("probe") == F.col("_f")) & (F.col("seen") == F.col("_handle")), "left")
        hit, asked = F.col("_e").isNotNull(), F.col("probe").isNotNull()
        s = s.select(
            "conv_id", "len", "hash", F.when(hit, F.col("_e")).otherwise(F.col("lo")).alias("lo"), F.when(asked & ~hit, F.col("probe") - 1).otherwise(F.col("hi")).alias("hi"),
            *[F.when(hit, F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in ("e", "eh", "rep")],
        )
        if step % 4 == 3:
            s = cut_lineage(s)
    # where the last node's extent is a prefix of the conversation, it leaves at that node or on the child's edge
    s = _with_hash(_with_hash(s, stored, "conv_id", F.col("e"), "here", chunk), stored, "conv_id", F.col("e") + 1, "next", chunk)
    inside = (F.col("e") == 0) | F.coalesce(F.col("here") == F.col("eh"), F.lit(False))
    tops = handled.select((F.col("a") + 1).alias("_t"), F.col("top").alias("_top"), F.col("e").alias("_e"), F.col("eh").alias("_eh"), F.col("rep").alias("_rep"))
    s = s.withColumn("inside", inside).withColumn("down", F.when(F.col("inside"), F.col("e") + 1)).join(tops, (F.col("down") == F.col("_t")) & (F.col("next") == F.col("_top")), "left")
    child = F.col("_e").isNotNull()
    pick = lambda c: F.when(child, F.col("_" + c)).otherwise(F.col(c)).alias(c)
    return s.select("conv_id", "len", "hash", pick("e"), pick("eh"), F.when(child, F.col("_rep")).when(~F.col("inside"), F.col("rep")).alias("rep"))


def _leaving(rows: DataFrame, stored: DataFrame, chunk: int) -> DataFrame:
    """Where conversations leave the one beside them: at (last equal depth), ah (its hash), next (their hash one deeper). Equal ones drop out.

    ``rows`` has conv_id, len, hash, rep, and e, eh of the edge, which stay.
    """
    mine = stored.select("conv_id", "chunk", "hashes")
    beside = stored.select(F.col("conv_id").alias("rep"), "chunk", F.col("hashes").alias("theirs"))
    both = rows.join(mine, "conv_id").join(beside, ["rep", "chunk"], "left")
    same = F.aggregate(F.zip_with("hashes", F.coalesce("theirs", F.array().cast(f"array<{HASH}>")), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    # a longer ``theirs`` adds zeros only; equal hashes stand in front, as a prefix hash decides all before it
    both = both.withColumn("q", same)
    got = both.groupBy("conv_id", "len", "hash", "rep", "e", "eh").agg(
        F.sum("q").alias("at"),
        F.max(F.when(F.col("q") > 0, F.struct("chunk", F.expr("get(hashes, q - 1)").alias("h")))).alias("ah"),
        F.min(F.when(F.col("q") < F.size("hashes"), F.struct("chunk", F.expr("get(hashes, q)").alias("h")))).alias("next"),
    )
    return got.where("at < len").select("conv_id", "len", "hash", "e", "eh", "at", F.coalesce(F.col("ah.h"), F.expr(ROOT)).alias("ah"), F.col("next.h").alias("next"))


def _cut(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges cut at ``places`` (e, eh of the edge, at, ah)."""
    item = F.array_sort(F.collect_set(F.struct(F.col("at").alias("e"), F.col("ah").alias("eh"))))
    by = places.groupBy("e", "eh").agg(item.alias("cuts"))
    rows = edges.join(by, ["e", "eh"], "left")
    ends = F.concat(F.coalesce("cuts", F.array().cast(f"array<struct<e:bigint,eh:{HASH}>>")), F.array(F.struct("e", "eh")))
    rows = rows.select("a", F.col("ah"), "e", "rep", "leaf", ends.alias("ends")).select("a", "ah", F.col("e").alias("last"), "rep", "leaf", "ends", F.posexplode("ends").alias("k", "end"))
    before = F.get("ends", F.col("k") - 1)
    return rows.select(
        F.when(F.col("k") == 0, F.col("a")).otherwise(before["e"]).alias("a"), F.when(F.col("k") == 0, F.col("ah")).otherwise(before["eh"]).alias("ah"),
        F.col("end.e").alias("e"), F.col("end.eh").alias("eh"), "rep", (F.col("leaf") & (F.col("end.e") == F.col("last"))).alias("leaf"),
    )


EDGES = f"a long, ah {HASH}, e long, eh {HASH}, rep long, leaf boolean"


def insert(edges: DataFrame, leaving: DataFrame, stored: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie with all conversations of ``leaving`` (conv_id, len, hash, e and eh of the edge or node, at, ah, next)."""
    leaving = cut_lineage(leaving)
    while not leaving.isEmpty():
        edges = _cut(edges, leaving.where("at < e").select("e", "eh", "at", "ah"))
        one = F.struct(F.xxhash64("conv_id").alias("_by"), "conv_id", "len", "hash", "ah")
        drawn = cut_lineage(leaving.groupBy("at", "next").agg(F.min(one).alias("x")).select("at", "next", "x.*"))
        leaves = drawn.select(F.col("at").alias("a"), "ah", F.col("len").alias("e"), F.col("hash").alias("eh"), F.col("conv_id").alias("rep"), F.lit(True).alias("leaf"))
        edges = cut_lineage(edges.unionByName(leaves))
        beside = drawn.select("at", "next", F.col("conv_id").alias("rep"), F.col("len").alias("e"), F.col("hash").alias("eh"))
        rest = leaving.select("conv_id", "len", "hash", "at", "next").join(beside, ["at", "next"]).where("conv_id != rep").drop("at", "next")
        leaving = cut_lineage(_leaving(rest, stored, chunk))
    return edges


def build(stored: DataFrame, ends: DataFrame, first: int = FIRST_BATCH, chunk: int = CHUNK) -> DataFrame:
    """The compacted trie of all conversations: a (depth of the parent), ah, e, eh, rep, leaf for each edge; the root, depth 0, has none."""
    edges = stored.sparkSession.createDataFrame([], EDGES)
    longest = ends.agg(F.max("len")).first()[0] or 0
    turn = F.pmod(F.xxhash64(F.lit("batch"), "conv_id"), F.lit(first)) == 0
    for batch in (ends.where(turn), ends.where(~turn)):
        batch = batch.select("conv_id", "len", "hash")
        if edges.isEmpty():
            at = batch.select("*", F.lit(0).cast("long").alias("e"), F.expr(ROOT).alias("eh"), F.lit(None).cast("long").alias("rep"))
        else:
            at = cut_lineage(locate(batch, cut_lineage(with_handles(edges, stored, chunk)), stored, longest, chunk))
        alone = _with_hash(at.where("rep IS NULL AND e < len"), stored, "conv_id", F.col("e") + 1, "next", chunk)
        alone = alone.select("conv_id", "len", "hash", "e", "eh", F.col("e").alias("at"), F.col("eh").alias("ah"), "next")
        edges = insert(edges, alone.unionByName(_leaving(at.where("rep IS NOT NULL"), stored, chunk)), stored, chunk)
    return edges


SUMS = ("n_convs", "leaves", "all_words", "edge_words")


def subtrees(edges: DataFrame, stored: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every compacted node, the root included, with sums over its subtree: n_convs, smallest, leaves (childless nodes of the expanded
    trie), all_words (of the whole conversations that end there), edge_words (each edge's words once), and words_a, words_e along its edge."""
    words = stored.select(F.col("conv_id").alias("rep"), "chunk", "words")
    ask = edges.withColumn("_x", F.explode(F.array(F.struct(F.lit(False).alias("low"), F.col("e").alias("d")), F.struct(F.lit(True).alias("low"), F.col("a").alias("d")))))
    ask = ask.withColumn("chunk", F.floor((F.greatest(F.col("_x.d"), F.lit(1)) - 1) / chunk).cast("long")).join(words, ["rep", "chunk"])
    ask = ask.withColumn("_w", F.when(F.col("_x.d") == 0, 0).otherwise(F.get("words", (F.col("_x.d") - 1 - F.col("chunk") * chunk).cast("int"))))
    names = ["a", "ah", "e", "eh", "rep", "leaf"]
    rows = ask.groupBy(*names).agg(F.max(F.when(F.col("_x.low"), F.col("_w"))).alias("words_a"), F.max(F.when(~F.col("_x.low"), F.col("_w"))).alias("words_e"))
    own = ends.groupBy(F.col("len").alias("e"), F.col("hash").alias("eh")).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("smallest"), F.sum("words").alias("all_words"))
    rows = rows.join(own, ["e", "eh"], "left")
    zero = F.lit(0).cast("long")
    s = rows.select(
        F.struct("e", "eh").alias("id"), F.struct(F.col("a").alias("e"), F.col("ah").alias("eh")).alias("up"), "rep", "leaf", "words_a", "words_e",
        F.coalesce("n_convs", zero).alias("n_convs"), "smallest", (F.col("leaf") & (F.col("e") - 1 > F.col("a"))).cast("long").alias("leaves"), F.coalesce("all_words", zero).alias("all_words"),
        (F.col("words_e") - F.col("words_a")).alias("edge_words"),
    )
    root = s.limit(1).select(
        F.expr(f"named_struct('e', 0L, 'eh', {ROOT})").alias("id"), F.lit(None).cast(f"struct<e:bigint,eh:{HASH}>").alias("up"), F.lit(None).cast("long").alias("rep"), F.lit(False).alias("leaf"),
        zero.alias("words_a"), zero.alias("words_e"), zero.alias("n_convs"), F.lit(None).cast("long").alias("smallest"), zero.alias("leaves"), zero.alias("all_words"), zero.alias("edge_words"),
    )
    s = cut_lineage(s.unionByName(root).withColumn("far", F.col("up")))
    while not s.where("far IS NOT NULL").isEmpty():
        more = s.where("far IS NOT NULL").groupBy(F.col("far").alias("id")).agg(*[F.sum(c).alias("_" + c) for c in SUMS], F.min("smallest").alias("_smallest"))
        ahead = s.where("far IS NOT NULL").select(F.col("id").alias("far"), F.col("far").alias("_far"))
        s = s.join(more, "id", "left").join(ahead, "far", "left")
        s = cut_lineage(s.select(
            "id", "up", "rep", "leaf", "words_a", "words_e", *[(F.col(c) + F.coalesce("_" + c, zero)).alias(c) for c in SUMS],
            F.coalesce(F.least("smallest", "_smallest"), "smallest", "_smallest").alias("smallest"), F.col("_far").alias("far"),
        ))
    return s.drop("far")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(len, hash) of each distinct conversation with the SHA-256 of the ids of all its copies, in order, joined by commas.

    Ids are joined to texts of at most 4,096 ids first; the texts of one group then run through one digest in order, one at a time.
    """
    pieces = ends.groupBy("len", "hash", F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    rows = pieces.select("len", F.col("hash.u").alias("u"), F.col("hash.v").alias("v"), "piece", "ids")
    rows = rows.repartition("len", "u", "v").sortWithinPartitions("len", "u", "v", "piece")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        columns = ["len", "u", "v", "sha"]
        for x in batches:
            out = []
            for n, u, v, ids in zip(x["len"].tolist(), x["u"].tolist(), x["v"].tolist(), x["ids"], strict=True):
                if (n, u, v) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (n, u, v), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=columns)

    return rows.mapInPandas(digest, "len long, u long, v long, sha string").select("len", F.struct("u", "v").alias("hash"), "sha")


def nodes(edges: DataFrame, stored: DataFrame, ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The expanded trie: a row for each distinct prefix of turns."""
    s = subtrees(edges, stored, ends, chunk)
    none = hashlib.sha256(b"").hexdigest()
    real = ~F.col("leaf") | (F.col("id.e") - 1 > F.col("up.e"))  # not an end mark alone
    below = s.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum(real.cast("long")).alias("n_children"))
    over = s.select(F.col("id").alias("up"), F.col("smallest").alias("above"))
    shas = ends_digests(ends).select(F.struct(F.col("len").alias("e"), F.col("hash").alias("eh")).alias("id"), "sha")
    marked = s.where("leaf").join(shas, "id").select(F.when(real, F.col("id")).otherwise(F.col("up")).alias("id"), "sha")
    s = s.where(real | F.col("up").isNull()).join(below, "id", "left").join(over, "up", "left").join(marked, "id", "left")
    s = cut_lineage(s.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "sha": F.coalesce("sha", F.lit(none)), "e": F.when(F.col("leaf"), F.col("id.e") - 1).otherwise(F.col("id.e")), "a": F.col("up.e")}))
    root = s.where("up IS NULL").select(
        F.col("smallest").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("leaves", (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("all_words") - F.col("edge_words")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
    spans = F.explode(F.sequence(F.floor(F.col("a") / chunk).cast("long"), F.floor((F.col("e") - 1) / chunk).cast("long")))
    wide = s.where("up IS NOT NULL").withColumn("chunk", spans).join(stored.select(F.col("conv_id").alias("rep"), "chunk", "words_before", "words"), ["rep", "chunk"])
    # words before a depth: those of the depth above it in the chunk, or all of the chunks before
    wide = wide.select("*", F.posexplode(F.concat(F.array("words_before"), F.slice("words", 1, F.size("words") - 1))).alias("k", "before")).withColumn("depth", F.col("chunk") * chunk + F.col("k") + 1)
    at = wide.where("depth > a AND depth <= e")
    last, top = F.col("depth") == F.col("e"), F.col("depth") == F.col("a") + 1
    saved = F.col("all_words") - F.col("n_convs") * F.col("before") - (F.col("edge_words") - (F.col("before") - F.col("words_a")))
    return at.select(
        F.col("smallest").alias("conv_id"), "depth", F.when(top, F.col("above")).otherwise(F.col("smallest")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("sha")).otherwise(F.lit(none)).alias("ends_sha256"),
    ).unionByName(root)


def prefix_trie(conversations: DataFrame, first: int = FIRST_BATCH, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (conv_id, turn, role, text), a row for each node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null turns come first; equal turns of a conversation are ordered by role and text; null roles and texts are empty; repeated rows are
    turns of their own; rows without conv_id are left out; other columns are ignored; an empty table gives no rows, not even the root.
    """
    turns, convs = rebuilt(cut_lineage(numbered(conversations)))
    stored, ends = paths(turns, convs, chunk)
    return nodes(build(stored, ends, first, chunk), stored, ends, chunk)
