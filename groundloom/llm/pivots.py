"""Exact top-k inner products by pivot-table elimination.

Vectors are turned into whole numbers, so scores and norms are exact. The pivot table holds every vector's distances to many pivots. From
distances follow inner products with the pivots, and from those (by the pivots' Gram matrix) the part of a vector that lies in their span
and the length of the rest. Two vectors of known parts are at least |part difference| and |difference of rests| apart, and no bound from
these distances is larger: it beats the difference of distances to any one pivot. Turned round it is an upper bound of their score.

Queries and candidates meet in blocks: a task holds one block of each. The bounds of a block come from one matrix product. Candidates are
evaluated in the order of their bounds, for all queries of the block at once, until the next bound of each query is under its k-th best
score; a first threshold comes from a bounded sample of all rows. Blocks return at most k rows a query, which a ranking merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.llm.common import shared_table

PIVOTS = 48
#: Rows of the sample from which pivots are chosen and first thresholds are taken. Any sample gives exact results.
SAMPLE = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Candidates of a query evaluated at once, and queries looked at together.
STEP, QUERIES = 16, 256


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array of whole numbers), without rows of null id or vector or with null or non-finite components."""
    x = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(sound).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of float64, short ones filled with zeros: whole numbers under 2^53 in all sums, checked by the caller."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-first choice: each next pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def spans(poles: np.ndarray) -> np.ndarray:
    """What turns inner products with the pivots into coordinates along orthonormal directions of their span (pivots in the rows)."""
    if not len(poles):
        return np.zeros((0, 0))
    values, vectors = np.linalg.eigh(poles @ poles.T)
    use = values > 1e-9 * max(float(values.max()), 1.0)
    return vectors[:, use] / np.sqrt(values[use])


def coordinates(gaps: np.ndarray, norms: np.ndarray, poles: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Parts in the pivots' span and the length of the rest (last column), from squared norms and distances to the pivots."""
    along = ((norms[:, None] + (poles * poles).sum(axis=1) - gaps * gaps) / 2) @ turn if len(poles) else np.zeros((len(norms), 0))
    rest = np.sqrt(np.maximum(norms - (along * along).sum(axis=1), 0))
    return np.column_stack((along, rest))


def search_block(names: np.ndarray, x: np.ndarray, px: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, pv: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, candidate, score) of the ``k`` best candidates of each query that are over its ``floor``, and how many pairs were evaluated.

    ``ids`` are sorted; ``px`` and ``pv`` are coordinates.
    """
    # the score is at most the product of the parts plus that of the rests; the slack is more than the rounding of the distances
    slack = 1e-6 * (1 + (px * px).sum(axis=1)[:, None] + (pv * pv).sum(axis=1)[None])
    high = px @ pv.T + slack
    high[names[:, None] == ids[None]] = -math.inf
    best, scores = np.full((len(x), k), len(ids)), np.full((len(x), k), -math.inf)
    evaluated, live = 0, np.arange(len(x))
    while len(live):
        step = min(STEP, len(ids))
        rows = high[live]
        take = np.argpartition(-rows, step - 1, axis=1)[:, :step]
        bound = np.take_along_axis(rows, take, axis=1)
        good = (bound >= floor[live, None]) & (bound > -math.inf)
        q, c = np.nonzero(good)
        got = np.full(take.shape, -math.inf)
        got[q, c] = np.einsum("ij,ij->i", x[live[q]], v[take[q, c]])
        evaluated += len(q)
        np.put_along_axis(rows, take, -math.inf, axis=1)
        high[live] = rows
        both, place = np.concatenate((scores[live], got), axis=1), np.concatenate((best[live], np.where(good, take, len(ids))), axis=1)
        order = np.lexsort((place, -both), axis=1)[:, :k]  # places stand in the order of ids
        scores[live], best[live] = np.take_along_axis(both, order, axis=1), np.take_along_axis(place, order, axis=1)
        floor[live] = np.maximum(floor[live], scores[live, -1])
        live = live[rows.max(axis=1, initial=-math.inf) >= np.maximum(floor[live], -1e300)]
    found = best < len(ids)
    return [(int(names[i]), int(ids[best[i, j]]), int(scores[i, j])) for i, j in zip(*np.nonzero(found))], evaluated


def top_k(vectors: DataFrame, k: int = 5, is_query: Column | None = None, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query row (all, if fewer), ties to the smaller vec_id.

    ``is_query`` marks queries among the rows of (vec_id, embedding), by default ids divisible by 50. Rows of the query's vec_id are its
    own and no candidates; every other row is one, so a repeated row fills several ranks, while a repeated query is answered once.
    Null ids or vectors and null or non-finite components take no part; shorter vectors count as filled with zeros; other columns
    are ignored; an empty table gives no rows. Scores must fit in 2^53, else the job stops.
    """
    spark = vectors.sparkSession
    rows = shared_table(whole_vectors(vectors), "vectors")
    is_query = (F.col("vec_id") % 50 == 0) if is_query is None else is_query
    facts = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count(F.when(is_query, 1))).first()
    n, width, largest, n_queries = facts[0], facts[1] or 0, facts[2] or 0, facts[3]
    if width * float(largest) ** 2 >= 2.0**51:
        raise ValueError("components are too large for exact scores")
    draw = F.xxhash64("vec_id", F.lit(5))
    some = rows.where(F.pmod(draw, F.lit(1_000_000)) < math.ceil(2e6 * min(1.0, sample / max(n, 1)))).select("vec_id", "v").limit(sample).collect() if n else []
    some.sort(key=lambda r: r["vec_id"])
    known_ids, known = np.array([r["vec_id"] for r in some], dtype=np.int64), matrix([r["v"] for r in some], width)
    poles = choose_pivots(known, pivots)
    turn = spans(poles)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = matrix(x["v"].tolist(), width)
            gap = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (poles * poles).sum(axis=1) - 2 * v @ poles.T, 0))
            yield pd.DataFrame({"vec_id": x["vec_id"], "v": [r.tobytes() for r in v], "d": [r.tobytes() for r in gap]})

    pivot_table = shared_table(rows.mapInPandas(measure, "vec_id long, v binary, d binary"), "pivot-table")
    numbers = lambda column: np.frombuffer(b"".join(column)).reshape(len(column), -1)
    q_blocks, c_blocks = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n / candidate_block))
    block = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # a repeated id would fill one block with its copies: candidates are dealt by id and vector place instead
    dealt = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")
    queries = pivot_table.where(is_query).dropDuplicates(["vec_id"]).select(block(1, q_blocks).alias("qb"), every(c_blocks).alias("cb"), "vec_id", "v", "d")
    candidates = pivot_table.select(every(q_blocks).alias("qb"), dealt.alias("cb"), "vec_id", "v", "d")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(q) and len(c):
            c = c.sort_values("vec_id", kind="stable")
            ids, v, names = c["vec_id"].to_numpy(), numbers(c["v"]), q["vec_id"].to_numpy()
            pv = coordinates(numbers(c["d"]), (v * v).sum(axis=1), poles, turn)
            for s in range(0, len(q), QUERIES):
                x = numbers(q["v"].iloc[s : s + QUERIES])
                px = coordinates(numbers(q["d"].iloc[s : s + QUERIES]), (x * x).sum(axis=1), poles, turn)
                first = x @ known.T
                first[names[s : s + QUERIES, None] == known_ids[None]] = -math.inf
                floor = np.sort(first, axis=1)[:, -k].copy() if len(known) >= k else np.full(len(x), -math.inf)
                out += search_block(names[s : s + QUERIES], x, px, floor, ids, v, pv, k)[0]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
