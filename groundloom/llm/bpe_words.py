"""BPE encoding and decoding through a table of distinct words.

1. Each partition of documents cuts its texts into words (the vocabulary's pre-tokens) and numbers its distinct ones in order of first
   use. Two outputs of the same pass: the documents as rows of word numbers, and the words with (partition, number).
2. The words of all partitions are grouped to the distinct-word table with their places; every distinct word is encoded once.
3. The ids go back to the places they came from, partition by partition, and are joined to the documents by position; the ids of a
   partition's words are joined with the table of pieces, which gives the decoded texts.

The pass of step 1 runs twice, once for each output. Both outputs carry the number of the partition's words and a check value of every
64th of them: most partitions that came out differently stop the job, but not all, and then ids are wrong without an error. So ``encode``
asks for documents that come in the same order each time, as from stored files; it does not write others to the shared folder itself,
its caller has to (``shared_table``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundloom.llm.common import body, slices
from groundloom.llm.ragged import word_ends
from groundloom.llm.words import chunks, odd, pretokens


@lru_cache(maxsize=2)
def pieces_of(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return {i: p for p, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece for the whole vocabulary, added tokens included. Its size is the vocabulary's, whatever the input."""
    return spark.createDataFrame(list(pieces_of(path).items()), "id int, piece string")


#: The second pass is checked on every so many words.
CHECKED = 64
MASK = (1 << 62) - 1
#: How ids travel: two bytes hold every vocabulary of up to 65,536 ids.
WIDE = np.dtype("<u2")


class Numbered:
    """Words of one partition by number, and chunks as the numbers of their words."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.order: list[str] = []
        self.seen: dict[str, bytes] = {}
        self.marked, self.crc = 0, 0

    def mark(self) -> int:
        """Check value of every 64th of the words so far, with its number."""
        for k in range(self.marked, len(self.words), CHECKED):
            self.crc = self.crc + crc32(self.order[k].encode()) * (k + 1) & MASK
            self.marked = k + CHECKED
        return self.crc

    def learn(self, cut: list[str]) -> None:
        """Number the words of chunks not seen yet, in the order of the text."""
        for c in dict.fromkeys(cut):
            if c not in self.seen:
                numbers = []
                # an odd chunk is a word of its own: the library normalises and cuts it when it is encoded
                for w in [c] if odd(c) else pretokens(c):
                    if (k := self.words.get(w)) is None:
                        k = self.words[w] = len(self.words)
                        self.order.append(w)
                    numbers.append(k)
                self.seen[c] = np.array(numbers, dtype="<u4").tobytes()

    def text(self, text: str) -> bytes:
        cut = chunks(text)
        self.learn(cut)
        return b"".join(map(self.seen.__getitem__, cut))


def squeezed(numbers: bytes) -> bytes:
    """32-bit numbers, byte planes apart, compressed lightly: frequent words have small numbers."""
    return zstandard.compress(np.frombuffer(numbers, dtype=np.uint8).reshape(-1, 4).T.tobytes(), 1)


def spread_out(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of the ids) for every row of ``docs``.

    Null and empty texts have no ids and decode to the empty string. Rows with the same or a null doc_id are encoded each; other columns
    are ignored; an empty table gives an empty one. Special tokens inside a text become their ids, as in the library.
    """
    if word_ends(path).width > 1 << 16:
        raise ValueError("the vocabulary needs wider ids: raise WIDE")
    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), body(docs).alias("text"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Numbered()
        for x in batches:
            texts = x["text"].tolist()
            for a, b in slices(texts):
                out = [squeezed(own.text(t)) for t in texts[a:b]]
                yield pd.DataFrame({"part": x["part"].iloc[a:b], "doc_id": x["doc_id"].iloc[a:b], "numbers": out, "known": len(own.words), "mark": own.mark()})

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Numbered()
        part, told = -1, 0
        for x in batches:
            texts = x["text"].tolist()
            part = int(x["part"].iloc[0]) if len(x) else part
            for a, b in slices(texts):
                for t in texts[a:b]:
                    own.learn(chunks(t))
            new = own.order[told:]
            if new:
                yield pd.DataFrame({"part": part, "number": np.arange(told, told + len(new), dtype=np.int64), "word": new})
            told += len(new)

    @F.pandas_udf("binary")
    def ids_of(batch: pd.Series) -> pd.Series:
        model = word_ends(path)
        plain = [w for w in batch if not odd(w)]
        ids, counts = model.encode(plain) if plain else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        data, ends = ids.astype(WIDE).tobytes(), (np.cumsum(counts) * WIDE.itemsize).tolist()
        made = dict(zip(plain, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        return pd.Series([made[w] if w in made else np.array(model.library.encode(w, add_special_tokens=False).ids, dtype=WIDE).tobytes() for w in batch])

    place = (F.shiftleft("part", 32) + F.col("number")).alias("place")
    table = rows.mapInPandas(words, "part long, number long, word string").select("word", place).groupBy("word").agg(F.collect_list("place").alias("places"))
    table = table.select("places", ids_of("word").alias("ids"), F.crc32(F.col("word").cast("binary")).alias("crc"))
    back = table.select("ids", "crc", F.explode("places").alias("place"))
    number = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    back = back.select(F.shiftright("place", 32).alias("part"), number.cast("int").alias("number"), F.when(number % CHECKED == 0, F.col("crc")).alias("mark"), "ids")
    return _joined(rows.mapInPandas(numbered, "part long, doc_id string, numbers binary, known long, mark long"), back, docs, path)


OUT = "doc_id string, ids array<int>, decoded string"
#: Documents of one Arrow batch of the result.
BATCH = 256


def _joined(numbers: DataFrame, back: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    def join(d: pa.Table, w: pa.Table) -> pa.Table:
        lists = pa.list_(pa.int32())
        schema = pa.schema([("doc_id", pa.string()), ("ids", lists), ("decoded", pa.string())])
        if not d.num_rows:
            return schema.empty_table()
        w = w.take(np.argsort(w["number"].to_numpy(), kind="stable"))
        known, marks = d["known"].to_numpy(), d["mark"].to_numpy()
        told = w.filter(w["mark"].is_valid())
        mark = (told["mark"].to_numpy().astype(np.uint64) * (told["number"].to_numpy().astype(np.uint64) + np.uint64(1))).sum()
        if known.max() != w.num_rows or marks[known.argmax()] != int(mark) & MASK:
            raise RuntimeError("a partition came out differently in its second pass: write the documents to a table first")
        words_ids = w["ids"].to_pylist()
        n = np.fromiter(map(len, words_ids), dtype=np.int64, count=len(words_ids)) // WIDE.itemsize
        flat = np.frombuffer(b"".join(words_ids), dtype=WIDE).astype(np.int32)
        del w, told, words_ids
        ends = np.cumsum(n)
        starts = ends - n
        piece = list(map(pieces_of(path).__getitem__, flat.tolist()))
        spelled = [" ".join(piece[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        del piece
        out = []
        for batch in d.select(["doc_id", "numbers"]).to_batches(max_chunksize=BATCH):
            ids, texts, sizes = [], [], [0]
            for x in batch.column("numbers").to_pylist():
                k = spread_out(x)
                k = k[n[k] > 0]
                size = n[k]
                till = np.cumsum(size)
                ids.append(flat[np.repeat(starts[k] - (till - size), size) + np.arange(till[-1] if len(k) else 0)])
                texts.append(" ".join(map(spelled.__getitem__, k.tolist())))
                sizes.append(len(ids[-1]))
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), np.concatenate(ids)), pa.array(texts, pa.string())]
            out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(out, schema)

    done = numbers.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(join, OUT)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key`` and decoded for rows of ids (array of int), by a join of ids with pieces; rows of one key must be one row.

    Ids that are not in the vocabulary are left out, as the library does; null or empty ids decode to the empty string.
    """
    spelled = rows.select(key, F.posexplode("ids").alias("k", "id")).join(F.broadcast(piece_table(rows.sparkSession, path)), "id")
    texts = spelled.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("x")).select(F.col(key).alias("_key"), F.array_join("x.piece", " ").alias("decoded"))
    return rows.join(texts, rows[key].eqNullSafe(texts["_key"]), "left").select(rows[key], F.coalesce("decoded", F.lit("")).alias("decoded"))
