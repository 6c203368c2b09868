"""Concatenate and cut: all documents as one stream of token ids, cut into fixed windows.

1. Documents are tokenised once, into a table in the shared folder that holds, beside the ids, the tokens before the document in its
   partition (a running total of the task).
2. The partitions' totals, one row each, are summed up to each partition's place in the stream. That second pass makes global offsets.
3. Each document is cut where its span of the stream crosses a multiple of the window: boundary records say where a piece was cut.
Only the last sequence is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from groundloom.llm.common import body, lean, shared_table, slices
from groundloom.llm.words import chunk_ids

WINDOW = 2048
#: Partitions whose totals may be broadcast (24 bytes each).
MOST_PARTITIONS = 1_000_000
#: Ids of one row of the token table; a longer document is several rows.
ROW_IDS = 1 << 20


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, part, before (tokens before this row in its partition), start (before it in the document), doc_tokens, ids (bytes of whole numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = chunk_ids(path)
        wide = model.dtype.itemsize
        tail = np.array([end_id], dtype=model.dtype).tobytes()
        total = 0
        for x in batches:
            texts = x["text"].tolist()
            for a, b in slices(texts):
                rows = []
                for doc, part, ids in zip(x["doc_id"].iloc[a:b], x["part"].iloc[a:b], model.encode(texts[a:b]), strict=True):
                    ids += tail
                    n = len(ids) // wide
                    for s in range(0, n, ROW_IDS):
                        piece = ids[s * wide : (s + ROW_IDS) * wide]
                        rows.append((doc, part, total, s, n, piece))
                        total += len(piece) // wide
                yield pd.DataFrame(rows, columns=["doc_id", "part", "before", "start", "doc_tokens", "ids"])

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), body(docs).alias("text"))
    return shared_table(rows.mapInPandas(lean(run, path), "doc_id string, part long, before long, start long, doc_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens.

    doc_id, start (the document's tokens before the piece), length, doc_tokens, sequence_id, offset (place in the sequence),
    cut_before and cut_after (the document goes on in the sequence before or after), ids (binary: little-endian unsigned 32-bit).
    Every document ends with ``end_id``; null and empty texts are that id alone. Rows with the same or a null doc_id are documents
    of their own; other columns are ignored; an empty table gives no pieces. A document of any length is packed whole.
    """
    rows = token_table(docs, path, end_id)
    wide = chunk_ids(path).dtype
    totals = rows.groupBy("part").agg(F.sum(F.octet_length("ids") / wide.itemsize).cast("long").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if totals.count() > MOST_PARTITIONS:
        raise ValueError("too many partitions to broadcast their totals: coalesce the documents first")
    placed = rows.join(F.broadcast(offsets), "part").select("doc_id", "start", "doc_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out: list[tuple] = []
            for doc, start, n, at, ids in x.itertuples(index=False):
                ids = np.frombuffer(ids, dtype=wide).astype("<u4")
                edges = [0, *range(window - at % window, len(ids), window), len(ids)]
                for a, b in zip(edges, edges[1:]):
                    s = start + a
                    out.append((doc, s, b - a, n, (at + a) // window, (at + a) % window, s > 0, s + b - a < n, ids[a:b].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after", "ids"])

    done = placed.mapInPandas(lean(cut, path), "doc_id string, start long, length long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean, ids binary")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
