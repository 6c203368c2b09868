"""Byte-pair merges over many sequences at once, held as one flat array of symbols with start offsets.

In every round each sequence that still has a mergeable pair merges its lowest-ranked pair, the leftmost among equals: the order
in which one sequence alone would be merged, so the surviving symbols are those of the reference encoders. A round is a handful of
numpy passes over the unfinished sequences only. Sequences of more than ``LONG`` symbols would need as many rounds as they have
merges; they are merged alone with a heap, which gives the same symbols.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

LONG = 192
NONE = np.int64(1) << 40


class Merges:
    """``rank`` and ``made`` of the pair (left, right), looked up in sorted keys left * width + right."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, width: int):
        self.width = width
        keys = left.astype(np.int64) * width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.mades = np.append(keys[order], NONE), np.append(rank[order].astype(np.int64), NONE), np.append(made[order].astype(np.int64), -1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where the pair does not merge) and places in ``mades``."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all sequences to the end; every length is at least 1. Returns the surviving symbols and the new lengths."""
        symbols, lengths = symbols.astype(np.int64), lengths.astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(lengths > LONG):
            out = self.run_alone(symbols[starts[k] : starts[k + 1]].tolist())
            done.append((np.array([k]), np.array([len(out)]), np.array(out, dtype=np.int64)))
        own = np.flatnonzero(lengths <= LONG)
        flat = symbols if len(own) == len(lengths) else symbols[np.repeat(lengths <= LONG, lengths)]
        size = lengths[own]
        rank, place = self._pairs(flat, size)
        while len(own):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            live = best < NONE
            if not live.all():
                stay = np.repeat(live, size)
                done.append((own[~live], size[~live], flat[~stay]))
                own, size, best, flat, rank, place = own[live], size[live], best[live], flat[stay], rank[stay], place[stay]
                if not len(own):
                    break
            seq = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(rank == best[seq])
            hit = hit[np.append(True, seq[hit[1:]] != seq[hit[:-1]])]  # one for each sequence, the leftmost
            flat[hit] = self.mades[place[hit]]
            keep = np.ones(len(flat), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
            flat, rank, place = flat[keep], rank[keep], place[keep]
            size = size - 1
            first = np.cumsum(size) - size
            last = first + size - 1
            rank[last] = NONE
            for i in (at[at < last], at[at > first] - 1):  # the pairs that hold a merged symbol
                rank[i], place[i] = self.look_up(flat[i], flat[i + 1])
        counts = np.zeros(len(lengths), dtype=np.int64)
        for k, n, _ in done:
            counts[k] = n
        out, ends = np.empty(counts.sum(), dtype=np.int64), np.cumsum(counts)
        for k, n, s in done:
            out[np.repeat(ends[k] - n - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        return out, counts

    def _pairs(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, place = np.full(len(flat), NONE), np.zeros(len(flat), dtype=np.int64)
        if len(flat) > 1:
            rank[:-1], place[:-1] = self.look_up(flat[:-1], flat[1:])
        if len(size):
            rank[np.cumsum(size) - 1] = NONE
        return rank, place

    def run_alone(self, seq: list[int]) -> list[int]:
        """The same for one long sequence: a heap of pairs by (rank, position) over a linked list."""
        n = len(seq)
        table = self._dict
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(x[0], i, seq[i], seq[i + 1], x[1]) for i in range(n - 1) if (x := table.get((seq[i], seq[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or seq[i] != a or seq[j] != b:
                continue
            seq[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (x := table.get((seq[p], seq[q]))):
                    heapq.heappush(heap, (x[0], p, seq[p], seq[q], x[1]))
        return [s for s, a in zip(seq, alive, strict=True) if a]

    @property
    def _dict(self) -> dict:
        if not hasattr(self, "_as_dict"):
            self._as_dict = {(int(k) // self.width, int(k) % self.width): (int(r), int(m)) for k, r, m in zip(self.keys[:-1], self.ranks[:-1], self.mades[:-1], strict=True)}
        return self._as_dict


def byte_letters() -> list[str]:
    """The published byte-to-letter table of byte-level BPE: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordEnds:
    """A vocabulary of byte-level BPE with word ends (a tokenizers JSON file): ids of pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = self.library.get_vocab_size()
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], dtype=np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64)
        self.merges = Merges(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)), pairs[:, 2], self.width)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens (none empty, lower case already) in one array, and how many each has."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return self.merges.run(symbols, lengths)


@lru_cache(maxsize=2)
def word_ends(path: str) -> WordEnds:
    return WordEnds(path)
