"""The text operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundloom.llm import alignment, bpe_words, langid, licenses, packing, phrases, pii, piece_counts, pivots, quality, secrets, simhash, trie
from groundloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_BPE, PIECE_BPE, BYTE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality.learn(docs, table(spark, folder, "labels"))
    return quality.judge(docs, rules).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", *[f for f in quality.FEATURES if f.endswith(("rate", "word"))]
    )


@query(
    "op2_pivot_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.top_k(table(spark, folder, "embeddings"))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = langid.held_out(docs["doc_id"])
    found = langid.identify(docs, langid.train(docs.where(~out)))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", F.to_json("languages").alias("languages"))


@query("op4_secret_forest")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after")


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query("op7_pii")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    fixed = found.withColumn("base", F.filter("spans", lambda s: s["fixed"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return fixed.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op8_bpe_words")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe_words.encode(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_simhash_near_dups")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),"
    " lambda crc, x: list_reduce(list_prepend(xor(crc, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))))"
)


@query(
    "op11_prefix_trie",
    f"""
    WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
               FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) q),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t) q),
    r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL
          SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
    whole AS (SELECT c.conv_id, coalesce(list((r.role, r.text) ORDER BY r.k) FILTER (WHERE r.k IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
    p AS (SELECT conv_id, len(turns) AS n, d, md5(CAST(turns[1:d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(turns[1:d - 1] AS VARCHAR)) END AS up,
          CASE WHEN d > 0 THEN len(regexp_extract_all(struct_extract_at(turns[d], 2), '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
          FROM (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM whole) q),
    node AS (SELECT d, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
             sha256(array_to_string(coalesce(list_sort(list(conv_id) FILTER (WHERE d = n)), []), ',')) AS ends FROM p GROUP BY d, node),
    kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
    line AS (SELECT DISTINCT p.d, p.node, q.d AS low_d, q.node AS low FROM p JOIN p q ON q.conv_id = p.conv_id AND q.d >= p.d),
    below AS (SELECT line.d, line.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(m.saved) AS saved
              FROM line JOIN node m ON m.d = line.low_d AND m.node = line.low LEFT JOIN kids k ON k.d = m.d AND k.node = m.node GROUP BY 1, 2)
    SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
     CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
    FROM node m JOIN below b ON b.d = m.d AND b.node = m.node LEFT JOIN kids k ON k.d = m.d AND k.node = m.node LEFT JOIN node u ON u.d = m.d - 1 AND u.node = m.up
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def _words(column: str) -> str:
    """The words of the decontamination contract in SQL: A-Z lower-cased, letters and digits of ASCII and everything beyond it."""
    return (
        f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


@query(
    "op13_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
    cut AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i
            FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS words, array_to_string(w[i:i + n - 1], ' ') AS g FROM cut),
    p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) q),
    occ AS (SELECT DISTINCT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON p.n = win.n AND p.g = win.g),
    hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM occ) q GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM occ WHERE item_id IS NOT NULL GROUP BY doc_id),
    spread AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
    term AS (SELECT DISTINCT g, unnest(words) AS word FROM win),
    many AS (SELECT g, count(*) AS k FROM term GROUP BY g),
    seen AS (SELECT w.doc_id, term.g, w.word, w.i FROM spread w JOIN term ON w.word = term.word),
    whole AS (SELECT s.doc_id, s.g, any_value(m.k) AS k FROM seen s JOIN many m ON m.g = s.g GROUP BY s.doc_id, s.g HAVING count(DISTINCT s.word) = any_value(m.k)),
    spot AS (SELECT s.doc_id, s.g, s.word, s.i, whole.k FROM seen s JOIN whole ON whole.doc_id = s.doc_id AND whole.g = s.g),
    near AS (SELECT DISTINCT doc_id, g FROM (SELECT a.doc_id, a.g, a.i FROM spot a JOIN spot b ON b.doc_id = a.doc_id AND b.g = a.g AND b.i BETWEEN a.i AND a.i + 19
             GROUP BY a.doc_id, a.g, a.i, a.word, a.k HAVING count(DISTINCT b.word) = a.k) q),
    close_by AS (SELECT near.doc_id, count(DISTINCT win.item_id) AS n_near FROM near JOIN win ON win.g = near.g GROUP BY near.doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
     sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near
    FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id LEFT JOIN close_by c ON c.doc_id = d.doc_id
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = phrases.matches(phrases.index(docs), table(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["till"] - s["start"]))
    return found.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )
