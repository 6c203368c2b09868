"""Alignment of two tokenizers' tokens by pointer jumping.

Tokens of both sides lie on the bytes of a text. Every token points to its farthest-right overlapping token (itself where none of the
other side reaches further; of two tokens that end together, the second side's points to the first's). Doubling the pointers,
``to = to[to]``, takes each token to the last token of its connected component, whose number names the group: groups are the stretches
between places where both sides end. All documents of a slice are doubled at once.

How often an id pair overlaps in the whole corpus needs all documents first, so the work has two halves:

1. Each task cuts its documents into blocks of bounded size and numbers a block's distinct id pairs. Written to the shared folder: a row
   for each document (digests, and its links as pair numbers) and rows of pairs with their counts in the block.
2. Pair counts are summed over blocks; the best count of an id is the largest of its pairs. Counts travel back to (block, number)
   through a join on the pair, and meet the block's documents there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundloom.llm.bpe_words import spread_out, squeezed
from groundloom.llm.common import body, shared_table, slices
from groundloom.llm.ragged import byte_letters

#: A block of documents ends when it holds so many distinct pairs or so many links.
BLOCK_PAIRS, BLOCK_LINKS = 300_000, 4_000_000
#: Pairs in one stored row.
ROW_PAIRS = 4096
#: Texts with a longer run of white space, or a longer word, go to the slower encoder that has no trouble with them.
LONG_BLANK, LONG_WORD = 256, 4096

_blank_run = re.compile(r"\s{%d}" % LONG_BLANK).search


class ByteSide:
    """Byte-level BPE (a tokenizers JSON file): ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            if all(c in byte for c in piece):
                self.bytes[i] = bytes(byte[c] for c in piece)
        special = {t["id"] for t in file["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode(t, add_special_tokens=False).ids if _blank_run(t) or max(map(len, t.split()), default=0) > LONG_WORD else self.fast.encode_ordinary(t) for t in texts]


class PieceSide:
    """A sentencepiece model: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        piece = self.library.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(path_a), PieceSide(path_b)


@lru_cache(maxsize=2)
def _spelled(n: int, marks: str) -> list[list[str]]:
    """Decimal ids followed by each of ``marks``."""
    return [[f"{i}{m}" for i in range(n)] for m in marks]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def last_tokens(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The last token of each token's component: numbers of the first side, then those of the second, which start at ``len(start_a)``.

    Both sides cover the same bytes without gaps.
    """
    n = len(start_a)
    reach_a = np.searchsorted(start_b, end_a - 1, side="right") - 1  # the second side's token on a token's last byte
    reach_b = np.searchsorted(start_a, end_b - 1, side="right") - 1
    to = np.concatenate((
        np.where(end_b[reach_a] > end_a, n + reach_a, np.arange(n)),
        np.where(end_a[reach_b] >= end_b, reach_b, n + np.arange(len(start_b))),
    ))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


class Aligned:
    """Tokens of the documents of a slice that both sides spell alike, their groups and links."""

    def __init__(self, a: ByteSide, b: PieceSide, texts: list[str]):
        whole = [" " + t if t else "" for t in texts]
        used = [k for k, t in enumerate(whole) if t]
        ids_a, ids_b = [[] for _ in texts], [[] for _ in texts]
        for k, x, y in zip(used, a.encode([whole[k] for k in used]), b.encode([texts[k] for k in used]), strict=True):
            raw = whole[k].encode()
            if b"".join(map(a.bytes.__getitem__, x)) == raw and b"".join(map(b.bytes.__getitem__, y)) == raw:
                ids_a[k], ids_b[k] = x, y
        self.n_a, self.n_b = (np.fromiter(map(len, s), dtype=np.int64, count=len(texts)) for s in (ids_a, ids_b))
        self.a, self.b = (np.fromiter((i for x in s for i in x), dtype=np.int64, count=n.sum()) for s, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        size_a, size_b = np.array([len(x) for x in a.bytes])[self.a], np.array([len(x) for x in b.bytes])[self.b]
        start_a, start_b = starts_of(size_a), starts_of(size_b)
        end_a, end_b = start_a + size_a, start_b + size_b
        n = len(self.a)
        last = last_tokens(start_a, end_a, start_b, end_b)
        self.group_a, self.group_b = last[:n], last[n:]
        # links: each token of the first side with the second side's tokens from its first byte to its last
        low = np.searchsorted(start_b, start_a, side="right") - 1
        many = np.searchsorted(start_b, end_a - 1, side="right") - low
        self.link_a = np.repeat(np.arange(n), many)
        self.link_b = np.repeat(low - starts_of(many), many) + np.arange(many.sum())
        self.first_a, self.first_b = starts_of(self.n_a), starts_of(self.n_b)
        self.links = np.concatenate(([0], np.cumsum(many)))
        self.n_links = self.links[self.first_a + self.n_a] - self.links[self.first_a]
        closes = np.concatenate(([0], np.cumsum(self.group_a == np.arange(n))))  # a group's terminal token is of the first side
        self.n_groups = closes[self.first_a + self.n_a] - closes[self.first_a]
        self.vocabularies = len(a.bytes), len(b.bytes)

    def spelled(self) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        n, m = len(self.a), len(self.b)
        tail_a = self.group_a == np.arange(n)
        tail_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[:m]
        # a group's tokens of the first side come before those of the second
        groups_a, groups_b = starts_of(tail_a.astype(np.int64)), starts_of(tail_b.astype(np.int64))
        ends_a, ends_b = np.flatnonzero(tail_a) + 1, np.flatnonzero(tail_b) + 1
        before = np.concatenate(([0], ends_b))
        out = np.empty(n + m, dtype=object)
        for where, ids, tail, width, marks in (
            (np.arange(n) + before[groups_a], self.a, tail_a, self.vocabularies[0], ",|"),
            (np.arange(m) + ends_a[groups_b], self.b, tail_b, self.vocabularies[1], ",;"),
        ):
            inner, final = (np.array(x, dtype=object) for x in _spelled(width, marks))
            out[where] = np.where(tail, final[ids], inner[ids])
        out = out.tolist()
        for s, k in zip((self.first_a + self.first_b).tolist(), (self.n_a + self.n_b).tolist(), strict=True):
            yield "".join(out[s : s + k])[:-1]

    def keys(self) -> np.ndarray:
        """Id pair of every link as one number."""
        return self.a[self.link_a] * self.vocabularies[1] + self.b[self.link_b]


class Numbered:
    """The distinct pairs of a block, numbered in the order they come up, with their counts."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.int64)  # sorted
        self.numbers = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)  # by number
        self.links = 0

    def learn(self, keys: np.ndarray) -> np.ndarray:
        found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        number = np.empty(len(found), dtype=np.int64)
        number[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        number[new] = len(self.keys) + np.arange(len(new))
        self.keys, self.numbers = np.insert(self.keys, at[new], found[new]), np.insert(self.numbers, at[new], number[new])
        self.counts = np.concatenate((self.counts, np.zeros(len(new), dtype=np.int64)))
        self.counts[number] += counts
        self.links += len(keys)
        return number[inverse]

    def rows(self) -> Iterator[tuple[list, list, int]]:
        """Pairs and counts by number, in rows of ``ROW_PAIRS``, with each row's first number."""
        by_number = self.keys[np.argsort(self.numbers)]
        for s in range(0, len(by_number), ROW_PAIRS):
            yield by_number[s : s + ROW_PAIRS], self.counts[s : s + ROW_PAIRS], s


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
STORED = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers binary, first long, pairs array<long>, counts array<long>"


def tokenised(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """The table of the first half: document rows (``first`` null) and pair rows of blocks."""
    names = [c.split()[0] for c in STORED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = sides(path_a, path_b)
        own, block = Numbered(), 0

        def close() -> Iterator[pd.DataFrame]:
            for pairs, counts, first in own.rows():
                yield pd.DataFrame([(block, None, *[None] * 6, first, pairs, counts)], columns=names)

        for x in batches:
            if not len(x):
                continue
            texts, place = x["text"].tolist(), int(x["part"].iloc[0]) << 32
            block = block or place
            for s, e in slices(texts):
                got = Aligned(a, b, texts[s:e])
                numbers = own.learn(got.keys()).astype("<u4")
                at = got.links[got.first_a].tolist()
                rows = [
                    (block, doc, na, nb, ng, nl, hashlib.sha256(text.encode()).hexdigest() if na else "", squeezed(numbers[k : k + nl].tobytes()), None, None, None)
                    for doc, na, nb, ng, nl, text, k in zip(
                        x["doc_id"].iloc[s:e], got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist(), got.n_links.tolist(), got.spelled(), at, strict=True
                    )
                ]
                yield pd.DataFrame(rows, columns=names)
                if len(own.keys) >= block_pairs or own.links >= block_links:
                    yield from close()
                    own, block = Numbered(), block + 1
        yield from close()

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), body(docs).alias("text"))
    return shared_table(rows.mapInPandas(run, STORED), "aligned")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (links in the whole corpus that hold it) and best (whether no pair of its second id has more).

    The largest counts are a row for each id of the second vocabulary at most, whatever the input, so they are broadcast.
    """
    each = rows.where("first IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("k"))
    n = each.groupBy("pair").agg(F.sum("k").alias("n")).withColumn("b", F.col("pair") % width)
    n = shared_table(n, "pairs")
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return n.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


OUT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A is a byte-level BPE file that reads a space and the text, side B a sentencepiece model that reads the text. Null and empty
    texts, and texts that either side does not spell byte for byte (a U+2581 in the text, for one), have no tokens: zeros and ''.
    Strings of special tokens are plain text. Repeated rows, and rows with the same or a null doc_id, are aligned and counted each;
    pairs of equal counts are all best; other columns are ignored; an empty table gives an empty one. Texts of any length are aligned whole.
    """
    rows = tokenised(docs, path_a, path_b, block_pairs, block_links)
    n = pair_counts(rows, len(sides(path_a, path_b)[1].bytes))
    spots = rows.where("first IS NOT NULL").select("block", "first", F.posexplode("pairs").alias("k", "pair")).select("block", (F.col("first") + F.col("k")).alias("number"), "pair")
    back = spots.join(n, "pair").select(F.col("block").alias("of"), "number", "n", "best")
    own = rows.where("first IS NULL").select("block", "doc_id", *COUNTS, "groups_sha256", "numbers")

    def meet(d: pa.Table, w: pa.Table) -> pa.Table:
        many, best = np.zeros(w.num_rows, dtype=np.int64), np.zeros(w.num_rows, dtype=np.int64)
        if w.num_rows:
            at = w["number"].to_numpy()
            many[at], best[at] = w["n"].to_numpy(), w["best"].to_numpy(zero_copy_only=False)
        sums = [(int(best[k].sum()), int(many[k].sum())) for k in (spread_out(x.as_py()) for x in d["numbers"])]
        columns = {c: d[c] for c in ("doc_id", *COUNTS)} | {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64()), "groups_sha256": d["groups_sha256"]}
        return pa.table({k: (v.cast(pa.string()) if k in ("doc_id", "groups_sha256") else v) for k, v in columns.items()})

    done = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(meet, OUT)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
