"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that may be near share a bucket key. The members of buckets are laid out in blocks: bit plane b holds bit b of 64
members in a word, so one word operation compares a fingerprint with 64 others in one bit. The differences run into carry-save
counters preset so that they overflow when the radius is passed; (fingerprint, word) entries all of whose lanes have overflowed are
abandoned. A block returns a spanning star of each group that it finds, not the pairs.

``near_fingerprints`` finds every pair within two bits: four blocks of 16 bits, of which such pairs agree in at least two, give six keys.
``near_texts`` finds texts of similarity 0.8 or more on five-word shingles: there the distance of a 64-bit fingerprint is up to
14 bits, too far for agreeing blocks, so keys are bands of minima over shingle hashes and the compared fingerprint has 256 bits. What
is near there is a candidate only: its Jaccard similarity is computed from the texts before it counts as a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.llm.common import body, lean, shared_table
from groundloom.llm.components import components

#: Members of one block. Larger buckets take the ways described at ``near_fingerprints`` and ``near_texts``.
BLOCK = 2048
#: Shingles whose bits are counted at once.
STEP = 1 << 15
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, other bytes as they are


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` words (white space is ASCII's), repeats included; the whole sequence if it is shorter; none without a word."""
    words = text.encode().translate(LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)])))


def majority(digests: bytes, width: int) -> bytes:
    """The bits set in over half of the digests (``width`` bytes each, most significant bit first); all zero for none."""
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(-1, width)
    counts = np.zeros(8 * width, dtype=np.int64)
    for k in range(0, len(rows), STEP):
        counts += np.unpackbits(rows[k : k + STEP], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(rows)).tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id (as given) and fp (8 bytes): the SimHash of XXH64 (seed 42) over shingles of ``size`` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = partial(xxhash.xxh64_digest, seed=42)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": [majority(b"".join(map(digest, shingles(t, size))), 8) for t in x["text"]]})

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), body(docs).alias("text")).mapInPandas(lean(run), "doc_id string, fp binary")
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "fp")


# ---- comparison in blocks


def near_in_block(members: list[bytes], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs of ``members`` that differ in at most ``radius`` bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(members), dtype=np.uint8).reshape(len(members), -1), axis=1)
    n, width = bits.shape
    words = -(-n // 64)
    lanes = np.zeros((width, words * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")  # plane b, word w: bit b of members 64 w .. 64 w + 63
    masks = (np.uint64(0) - bits.astype(np.uint64)).T  # plane b, member: all ones where the bit is set
    full = ~np.uint64(0)
    depth = max(1, radius.bit_length())
    spare = (1 << depth) - 1 - radius  # the counters overflow at radius + 1 differences
    found_i, found_j = [], []
    for a in range(0, n, 256):
        b = min(n, a + 256)
        who, word = (x.ravel() for x in np.meshgrid(np.arange(a, b), np.arange(a // 64, words), indexing="ij"))
        count = [np.full(len(who), full if spare >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
        over = np.zeros(len(who), dtype=np.uint64)
        for plane in range(width):
            carry = planes[plane][word] ^ masks[plane][who]
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if plane % 8 == 7 and plane >= radius:
                live = over != full
                if not live.all():
                    who, word, over, count = who[live], word[live], over[live], [c[live] for c in count]
                    if not len(who):
                        break
        if len(who):
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, lane = np.nonzero(near)
            i, j = who[e], word[e] * 64 + lane
            keep = (i < j) & (j < n)
            found_i.append(i[keep])
            found_j.append(j[keep])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place of each place's group, given the pairs."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def compare_blocks(blocks: DataFrame, radius: int, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """Links (a, b: fingerprints) that join what is near in the first ``width`` bytes (None: all) in each row of ``blocks`` (members: array of fingerprints).

    Short rows are compared together, up to ``block`` members at once: a near pair from two rows is a true link too. A longer row is
    compared in parts of half a block, every two of them at once.
    """
    half = max(1, block // 2)

    def links(members: list[bytes]) -> list[tuple[bytes, bytes]]:
        members = sorted(set(members))
        if len(members) > 2 * half:
            cut = [members[k : k + half] for k in range(0, len(members), half)]
            return [x for p, q in combinations(cut, 2) for x in links(p + q)]
        root = stars(len(members), *near_in_block([m[:width] for m in members], radius))
        return [(members[k], members[r]) for k, r in enumerate(root.tolist()) if k != r]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[bytes] = []
        for x in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in x["members"]:
                if waiting and len(waiting) + len(row) > block:
                    out += links(waiting)
                    waiting = []
                waiting += list(row)
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(links(waiting) if waiting else [], columns=["a", "b"])

    return blocks.select("members").mapInPandas(lean(run), "a binary, b binary")


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` (t, key, fp) with n, the size of the bucket, for buckets of two or more. Sizes are counted before rows meet."""
    size = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keys.join(size, ["t", "key"])


# ---- fingerprints within two bits


def _block_keys() -> Column:
    """Six (t, key): the bytes of two of the four 16-bit blocks."""
    part = lambda k: F.substring("fp", 2 * k + 1, 2)
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.concat(part(p), part(q)).alias("key")) for t, (p, q) in enumerate(combinations(range(4), 2))]))


def near_fingerprints(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct 64-bit fingerprints ``fp`` differing in at most two bits.

    Buckets over ``block`` members are not compared: each of their fingerprints names itself and its 64 one-bit neighbours, and
    those that name the same value are linked to the smallest of them. Two fingerprints within two bits name a common value, so
    this is exact, and its rows grow in proportion to the members.
    """
    keys = shared_table(sized(fps.select("fp", _block_keys().alias("k")).select("k.t", "k.key", "fp")), "buckets")
    rows = keys.where(F.col("n") <= block).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    links = compare_blocks(rows, 2, block)
    large = keys.where(F.col("n") > block).select("fp").distinct()

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = np.frombuffer(b"".join(x["fp"]), dtype=">u8").astype(np.uint64)
            flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
            yield pd.DataFrame({"fp": np.repeat(x["fp"].to_numpy(), 65), "name": (v[:, None] ^ flips).astype(np.int64).ravel() if len(v) else np.zeros(0, dtype=np.int64)})

    named = large.mapInPandas(lean(names), "fp binary, name long")
    low = named.groupBy("name").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    return links.union(named.join(low, "name").select(F.col("fp").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())


def _labels(first: DataFrame, links: DataFrame) -> DataFrame:
    """fp, group (the smallest fingerprint of the component) and component_id (its smallest doc_id) for every row of ``first`` (fp, first)."""
    roots = components(links)
    known = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("group"))
    least = known.groupBy("group").agg(F.min("first").alias("component_id"))
    return known.join(least, "group").select("fp", "group", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, group and component_id for every row of ``docs``; fingerprints link at two bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id never is a component's name while another
    is there. Repeated rows are rows of the same component; other columns are ignored; an empty table gives an empty one.
    """
    rows = shared_table(fingerprints(docs, size), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return rows.join(_labels(first, near_fingerprints(first, block)), "fp").select("doc_id", "fp", "group", "component_id")


# ---- texts of similarity 0.8 and more

BANDS, ROWS = 16, 5
WIDE = 32
#: Bits of 256 in which texts of Jaccard similarity 0.8 differ: 39 expected (48 for four and five shingles), 6 standard deviation.
#: Unrelated texts: 128, 8. What lies within is a candidate, not a copy.
WIDE_RADIUS = 80
#: Words of the texts whose similarities one task computes at once, about.
BLOCK_WORDS = 4_000_000


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, row_key (hash of id and text), fp, keys (a key for each band of minima) and n (their number) of the texts' distinct shingles; no keys without a word.

    ``fp`` is 32 bytes to compare and a 128-bit hash of the whole set behind them: it is equal for equal sets only.
    """
    draw = np.random.default_rng(20)
    factor = draw.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        low, high = partial(xxhash.xxh3_128_digest, seed=42), partial(xxhash.xxh3_128_digest, seed=43)

        def sketch(text: str) -> tuple[bytes, list[int], int]:
            parts = list(set(shingles(text, size)))
            if not parts:
                return bytes(WIDE + 16), [], 0
            a, b = b"".join(map(low, parts)), b"".join(map(high, parts))
            own = low(b"".join(sorted(a[k : k + 16] for k in range(0, len(a), 16))))
            h = np.frombuffer(a, dtype="<u8")[::2]
            least = np.full((BANDS * ROWS, 1), ~np.uint64(0))
            for k in range(0, len(h), STEP):
                mixed = h[k : k + STEP] * factor + shift
                mixed ^= mixed >> np.uint64(29)
                least = np.minimum(least, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1, keepdims=True))
            keys = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, ROWS)]
            if len(parts) % 2 == 0:  # an odd number votes, so that unrelated short texts differ in half of the bits too
                k = 16 * int(h.argmax())
                a, b = a[:k] + a[k + 16 :], b[:k] + b[k + 16 :]
            return majority(a, 16) + majority(b, 16) + own, keys, len(parts)

        for x in batches:
            out = [sketch(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "row_key": x["row_key"], "fp": [f for f, _, _ in out], "keys": [k for _, k, _ in out], "n": [n for _, _, n in out]})

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), row_key(docs).alias("row_key"), body(docs).alias("text"))
    done = rows.mapInPandas(lean(run), "doc_id string, row_key string, fp binary, keys array<long>, n long")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def row_key(docs: DataFrame) -> Column:
    """The same for repeated rows, and (128 bits) for them only."""
    return F.concat(F.hex(F.xxhash64(docs["doc_id"], docs["text"])), F.lit("-"), F.hex(F.xxhash64(docs["text"], docs["doc_id"], F.lit(7))))


def meetings(parts: Column) -> Column:
    """(p, q), p <= q: the rows in which a fingerprint, dealt into one of ``parts``, meets all others."""
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(mine, k).alias("p"), F.greatest(mine, k).alias("q"))))


def candidate_links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``rows`` (fp, keys) that share a band and lie within the radius.

    Parts of a large bucket are filled to 0.8 of half a block on average, as a hash deals unevenly.
    """
    keys = rows.select("fp", "keys").distinct().select("fp", F.posexplode("keys").alias("t", "key"))
    found = shared_table(sized(keys), "bands")
    half = block // 2
    small = found.where(F.col("n") <= half).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    large = found.where(F.col("n") > half).select("t", "key", "fp", meetings(F.ceil(F.col("n") / (0.8 * half)).cast("int")).alias("x"))
    large = large.groupBy("t", "key", "x").agg(F.collect_list("fp").alias("members"))
    return compare_blocks(small.select("members").union(large.select("members")), WIDE_RADIUS, block, WIDE)


def similar(members: list[bytes], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places of pairs that join all ``members`` whose sets (sorted, distinct) have a Jaccard similarity of ``least``; what is joined already is not computed."""
    n = len(members)
    i, j = np.triu_indices(n, 1) if n <= 64 else near_in_block([m[:WIDE] for m in members], WIDE_RADIUS)
    sizes = np.array([len(s) for s in sets])
    can = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-6
    i, j = i[can], j[can]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    label, out = np.arange(n), []
    at = np.searchsorted(i, np.arange(n + 1))
    for a in range(n):
        for b in j[at[a] : at[a + 1]]:
            if label[a] != label[b]:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both / (sizes[a] + sizes[b] - both) >= least:
                    label[label == label[b]] = label[a]
                    out.append((a, int(b)))
    return out


def verified_links(docs: DataFrame, first: DataFrame, candidates: DataFrame, size: int, block: int, least: float) -> DataFrame:
    """Links (a, b) that join the texts of Jaccard similarity ``least`` among those that ``candidates`` join, by however long a chain.

    ``first`` (fp, row_key, n) names a row for each fingerprint. The texts of a group of candidates meet in one row of work; a larger
    group is dealt in parts, and every two parts meet, so every pair of a group is looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = partial(xxhash.xxh3_64_digest, seed=42)
        now, members, sets = None, [], []

        def links() -> pd.DataFrame:
            return pd.DataFrame([(members[a], members[b]) for a, b in similar(members, sets, least)], columns=["a", "b"])

        for x in batches:
            for root, p, q, fp, text in zip(x["root"], x["p"], x["q"], x["fp"], x["text"], strict=True):
                if now != (root, p, q):
                    if len(members) > 1:
                        yield links()
                    now, members, sets = (root, p, q), [], []
                members.append(fp)
                sets.append(np.unique(np.frombuffer(b"".join(map(digest, set(shingles(text, size)))), dtype="<u8")))
        if len(members) > 1:
            yield links()

    groups = components(candidates).select(F.col("node").alias("fp"), "root").join(first, "fp")
    groups = shared_table(groups.select("fp", "root", "row_key", "n"), "candidates")
    total = groups.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("words"))
    share = F.greatest(F.col("members") / (0.4 * block), F.col("words") / (0.4 * BLOCK_WORDS))
    parts = F.when((F.col("members") <= block) & (F.col("words") <= BLOCK_WORDS), 1).otherwise(F.ceil(share)).cast("int")
    dealt = groups.join(total.select("root", parts.alias("parts")), "root")
    texts = docs.select(row_key(docs).alias("row_key"), body(docs).alias("text"))
    named = texts.join(dealt, "row_key").dropDuplicates(["row_key"]).select("root", meetings(F.col("parts")).alias("x"), "fp", "text")
    named = named.select("root", "x.p", "x.q", "fp", "text").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return named.mapInPandas(lean(run), "a binary, b binary")


def near_texts(docs: DataFrame, size: int = 5, block: int = BLOCK, least: float = 0.78) -> DataFrame:
    """doc_id, row_key, fp, group and component_id for every row of ``docs``, linked at a Jaccard similarity of ``least`` or more on ``size``-word shingles.

    Texts of similarity 0.8 share a band with probability 0.998 and lie within the radius; those are candidates, of which a pair is a
    link only where its similarity, computed from the texts, is ``least``. A bucket or group of more than ``block`` members is dealt in
    parts, and every two parts meet in a row of their own, so no link is lost. Nulls, empty texts, repeated rows and other columns as
    in ``near_duplicates``.
    """
    rows = shared_table(sketches(docs, size), "sketches")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("row_key", "n")).alias("x")).select("fp", "first", "x.row_key", "x.n")
    links = verified_links(docs, first, candidate_links(rows, block), size, block, least)
    return rows.select("doc_id", "row_key", "fp").join(_labels(first, links), "fp").select("doc_id", "row_key", "fp", "group", "component_id")


def deduplicated(docs: DataFrame, least: float = 0.78) -> DataFrame:
    """One row of ``docs`` for each group of near copies, the one of smallest doc_id (ties: of smallest row_key), all columns as they are."""
    found = near_texts(docs, least=least)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("row_key").alias("key")).select("key")
    keyed = docs.select(row_key(docs).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
