"""Benchmark passages in training documents, by a distributed positional inverted index.

1. ``index``: every task cuts its documents into blocks of about two million characters and stores one row for each term of a block: its
   positions as differences (a term's positions run on over the block's documents, with a gap between two documents that no phrase can
   cross), and one row that lists the block's documents. A frequent term is a row of bounded size in each block, never one list.
2. ``matches``: the test windows' terms are counted over the whole index. In each block a window starts from the postings of its rarest
   term; the postings of the next rarer ones, shifted by their offsets, are intersected with what is left, all windows at once. The same
   lists give the proximity matches: the places where all words of a window stand within ``near`` words, in any order.

Windows go through the index in passes of bounded size; one pass does for some hundred thousand of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from groundloom.llm.common import body, shared_table, slices

#: Words of a window, and words within which those of a proximity match stand (63 at most: a place is a bit).
WINDOW, NEAR = 10, 20
#: Positions left out between two documents.
GAP = 64
#: Pairs of window and item that travel to the executors at once (about 40 MB).
PASS_WINDOWS = 200_000
#: A-Z to a-z, 0-9, a-z and bytes beyond ASCII as they are, all others to a blank.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

DOCS = pa.list_(pa.struct([("doc_id", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
STORED = "block long, term binary, postings binary, docs array<struct<doc_id:string,first:int,words:int>>"
ARROW = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("postings", pa.binary()), ("docs", DOCS)])


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def _block(number: int, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """The rows of one block, terms in order of first use."""
    term: defaultdict[bytes, int] = defaultdict()
    term.default_factory = term.__len__
    docs, ids, places, at = [], [], [], 0
    for doc, text in zip(doc_ids, texts, strict=True):
        own = words(text)
        ids.append(np.fromiter(map(term.__getitem__, own), dtype=np.int64, count=len(own)))
        places.append(np.arange(at, at + len(own)))
        docs.append({"doc_id": doc, "first": at, "words": len(own)})
        at += len(own) + GAP
    flat, place = np.concatenate(ids), np.concatenate(places)
    place = place[np.argsort(flat, kind="stable")]
    many = np.bincount(flat, minlength=len(term))
    starts = np.cumsum(many) - many
    steps = np.diff(place, prepend=0)
    steps[starts] = place[starts]
    n = len(term)
    ends = np.concatenate(([0], np.cumsum(many) * 4)).astype(np.int32)
    postings = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(steps.astype("<u4").tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * (n + 1), pa.int64()), pa.array([None, *term], pa.binary()), pa.concat_arrays([pa.nulls(1, pa.binary()), postings]), pa.array([docs] + [None] * n, DOCS)], schema=ARROW
    )


def index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs``: for each block a row without term that lists its documents, and a row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for x in batches:
            if not x.num_rows:
                continue
            number = number or x.column("part")[0].as_py() << 32
            texts, ids = x.column("text").to_pylist(), x.column("doc_id").to_pylist()
            for a, b in slices(texts):
                yield _block(number, ids[a:b], texts[a:b])
                number += 1

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.spark_partition_id().cast("long").alias("part"), body(docs).alias("text"))
    return shared_table(rows.mapInArrow(run, STORED), "postings")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item (string) and terms of each distinct window: ``size`` consecutive words, or all words of an item that has fewer, but not none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for item, text in zip(x.column("item").to_pylist(), x.column("text").to_pylist(), strict=True):
                own = words(text)
                cut = [own[k : k + size] for k in range(max(1, len(own) - size + 1))] if own else []
                for s in range(0, len(cut), 4096):
                    part = cut[s : s + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = items.select(items["item_id"].cast("string").alias("item"), body(items).alias("text"))
    return rows.mapInArrow(run, "item string, terms array<binary>").distinct()


class Sought:
    """The windows of one pass: terms by number, rarest first, with their offsets and the items that hold the window."""

    def __init__(self, pairs: list[tuple[str | None, list[bytes]]], counts: dict[bytes, int]):
        held: dict[tuple[bytes, ...], list[str]] = {}
        for item, terms in pairs:
            if all(t in counts for t in terms):  # a window with a word that no document has cannot occur
                own = held.setdefault(tuple(bytes(t) for t in terms), [])
                if item is not None:
                    own.append(item)
        self.items = list(held.values())
        self.size = np.array([len(w) for w in held], dtype=np.int64)
        self.number = {t: k for k, t in enumerate(dict.fromkeys(t for w in held for t in w))}
        most = int(self.size.max(initial=0))
        self.term, self.offset = np.full((len(held), most), -1, dtype=np.int64), np.zeros((len(held), most), dtype=np.int64)
        self.again = np.zeros((len(held), most), dtype=bool)  # a word that the window has before
        for k, w in enumerate(held):
            by = sorted(range(len(w)), key=lambda i: (counts[w[i]], w[i], i))
            self.term[k, : len(w)] = [self.number[w[i]] for i in by]
            self.offset[k, : len(w)] = by
            self.again[k, 1 : len(w)] = self.term[k, 1 : len(w)] == self.term[k, : len(w) - 1]


class Postings:
    """The postings of the sought terms in one block as sorted keys (term, position)."""

    def __init__(self, terms: np.ndarray, lists: list[bytes], n: int):
        by = np.argsort(terms, kind="stable")
        many = np.zeros(n + 1, dtype=np.int64)
        many[terms] = [len(x) // 4 for x in lists]
        steps = np.frombuffer(b"".join(lists[k] for k in by), dtype="<u4").astype(np.int64)
        own = many[:n][many[:n] > 0]
        starts = np.cumsum(own) - own
        total = np.cumsum(steps)
        self.at = total - np.repeat(total[starts] - steps[starts], own) if len(own) else total
        self.keys = np.append(np.repeat(np.flatnonzero(many[:n]), own) << 32 | self.at, np.int64(1) << 62)
        self.many, self.first = many, np.cumsum(many) - many

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of each of ``term``: the index into ``term``, and the position."""
        many = self.many[term]
        which = np.repeat(np.arange(len(term)), many)
        return which, self.at[np.repeat(self.first[term] - (np.cumsum(many) - many), many) + np.arange(len(which))]

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = term << 32 | at
        return self.keys[np.searchsorted(self.keys, key)] == key


def phrases(p: Postings, w: Sought) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of every occurrence."""
    if not len(w.size):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    which, at = p.of(w.term[:, 0])
    at = at - w.offset[which, 0]
    keep = at >= 0
    which, at = which[keep], at[keep]
    for r in range(1, w.term.shape[1]):
        if not len(which):
            break
        keep = w.size[which] <= r
        keep[~keep] = p.has(w.term[which[~keep], r], at[~keep] + w.offset[which[~keep], r])
        which, at = which[keep], at[keep]
    return which, at


def close(p: Postings, w: Sought, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its rarest word) wherever all its words stand within ``near`` words of each other around that word.

    Bit s of a candidate stands for the stretch that begins s words before its rarest word; each further word leaves the stretches that hold it.
    """
    if not len(w.size):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    which, at = p.of(w.term[:, 0])
    bits = np.full(len(which), (1 << near) - 1, dtype=np.int64)
    for r in range(1, w.term.shape[1]):
        if not len(which):
            break
        rest = np.flatnonzero((w.size[which] > r) & ~w.again[which, r])
        base, own = w.term[which[rest], r] << 32, at[rest]
        k = np.searchsorted(p.keys, base | np.maximum(own - near + 1, 0))
        end = np.searchsorted(p.keys, base | (own + near - 1), side="right")
        found = np.zeros(len(rest), dtype=np.int64)
        live = np.flatnonzero(k < end)
        while len(live):
            d = (p.keys[k[live]] & 0xFFFFFFFF) - own[live]
            low, high = np.maximum(0, -d), np.minimum(near - 1, near - 1 - d)
            found[live] |= (np.int64(2) << high) - (np.int64(1) << low)
            k[live] += 1
            live = live[k[live] < end[live]]
        bits[rest] &= found
        keep = bits != 0
        which, at, bits = which[keep], at[keep], bits[keep]
    return which, at


FOUND = "block long, number int, doc_id string, n_words long, spans array<struct<start:int,till:int>>, items array<string>, near_items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("till", pa.int32())]))
FOUND_ARROW = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("doc_id", pa.string()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])


def search_block(rows: pa.Table, w: Sought, near: int) -> pa.Table:
    """One row for each document of a block: merged spans of hit words, and the items found."""
    listed = [i for i, t in enumerate(rows["term"].to_pylist()) if t is None]
    docs = [d for i in listed for d in rows["docs"][i].as_py()]
    held = rows.filter(rows["term"].is_valid())
    number = np.array([w.number.get(bytes(t), -1) for t in held["term"].to_pylist()], dtype=np.int64)
    lists = held["postings"].to_pylist()
    p = Postings(number[number >= 0], [x for x, k in zip(lists, number) if k >= 0], len(w.number))
    first = np.array([d["first"] for d in docs], dtype=np.int64)
    found: list[defaultdict[int, set]] = []
    spans: defaultdict[int, list] = defaultdict(list)
    for which, at, exact in ((*phrases(p, w), True), (*close(p, w, near), False)):
        doc = np.searchsorted(first, at, side="right") - 1
        of: defaultdict[int, set] = defaultdict(set)
        for pair in np.unique(doc * max(1, len(w.size)) + which).tolist():
            d, k = divmod(pair, len(w.size))
            of[d].update(w.items[k])
        found.append(of)
        if exact and len(at):
            by = np.argsort(at, kind="stable")
            start, end = at[by], np.maximum.accumulate(at[by] + w.size[which[by]])
            new = np.append(True, start[1:] > end[:-1])  # spans that touch are one
            start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
            for d, s, e in zip((np.searchsorted(first, start, side="right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
                spans[d].append({"start": s - docs[d]["first"], "till": e - docs[d]["first"]})
    block = rows["block"][0].as_py()
    columns = [[block] * len(docs), list(range(len(docs))), [d["doc_id"] for d in docs], [d["words"] for d in docs], [spans.get(d, []) for d in range(len(docs))]]
    columns += [[sorted(of.get(d, ())) for d in range(len(docs))] for of in found]
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, FOUND_ARROW)], schema=FOUND_ARROW)


def _search(w: Broadcast, near: int):
    return lambda rows: search_block(rows, w.value, near)


def _union(parts: DataFrame) -> DataFrame:
    """One row for each document from those of several passes."""
    one = parts.groupBy("block", "number", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items")
    )
    merged = F.expr(
        "aggregate(spans, CAST(array() AS array<struct<start:int,till:int>>), (done, s) -> CASE WHEN size(done) > 0 AND element_at(done, -1).till >= s.start"
        " THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'till', greatest(element_at(done, -1).till, s.till)))) ELSE concat(done, array(s)) END)"
    )
    return one.select("block", "number", "doc_id", "n_words", merged.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near_items")).alias("near_items"))


def matches(postings: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR, most: int = PASS_WINDOWS) -> DataFrame:
    """One row for each indexed document: doc_id (string), n_words, spans, items, near_items.

    ``spans`` are the stretches of words that lie in an occurrence of a window of ``items`` (item_id, text), merged, as word numbers from 0,
    ``till`` exclusive; ``items`` the ids (strings, sorted) whose windows occur; ``near_items`` those with a window whose distinct words stand within
    ``near`` words. Null and empty texts have no words on either side; items of one id are one item; an item without an id hits words but
    is not listed; repeated documents have a row each; a table without items finds nothing; extra columns are ignored.
    """
    if not window <= near < GAP:
        raise ValueError("window <= near < 64 is needed")
    spark = postings.sparkSession
    sought = shared_table(windows(items, window), "windows")
    passes = max(1, -(-sought.count() // most))
    parts = None
    for k in range(passes):
        own = sought.where(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == k)
        terms = own.select(F.explode("terms").alias("term")).distinct()  # at most ``window`` for each of about ``most`` rows
        held = postings.join(F.broadcast(terms), "term")
        counts = {bytes(r["term"]): r["n"] for r in held.groupBy("term").agg(F.sum(F.octet_length("postings") / 4).alias("n")).collect()}
        w = spark.sparkContext.broadcast(Sought([(r["item"], r["terms"]) for r in own.collect()], counts))
        rows = postings.where("term IS NULL").unionByName(held.select(postings.columns))
        found = rows.groupBy("block").applyInArrow(_search(w, near), FOUND)
        parts = found if parts is None else parts.unionByName(found)
    return (parts if passes == 1 else _union(parts)).drop("block", "number")
