"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens that no merge can cross (a piece holds the space mark at its start only, and characters outside the
vocabulary join nothing). The pre-tokens a batch has not met yet are held as ragged numpy arrays, every sequence applies its
lowest-ranked pair in the same round, and the surviving symbols are counted: one for a piece, the UTF-8 length for a character
that falls back to bytes. A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundloom.llm.common import body, slices
from groundloom.llm.ragged import Merges

SPACE = "▁"
#: Pre-tokens remembered by a Python worker; beyond that it forgets them all and goes on.
REMEMBERED = 600_000


class Pieces:
    """A sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces that hold the space mark inside need another pre-tokeniser")
        self.width = n + 1  # symbol n: a character outside the vocabulary
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        rows = [(plain[p[:k]], plain[p[k:]], order[sp.get_score(i)], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        left, right, rank, made = np.array(rows, dtype=np.int64).T
        self.merges = Merges(left, right, rank, made, self.width)
        self.letter = np.full(0x110000, n, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        self.line_apart = self.letter[10] == n
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.line_apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, none of them empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.letter[points]
        owner = np.repeat(np.arange(len(words)), lengths)
        strange = symbols == self.width - 1
        more = np.zeros(len(words), dtype=np.int64)
        if strange.any():
            c = points[strange]
            np.add.at(more, owner[strange], (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))
        return self.merges.run(symbols, lengths)[1] + more

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in slices(texts):
            cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[a:b]]
            if new := list(set().union(*cut).difference(self.known)):
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = list(set().union(*cut))
                self.known.update(zip(new, self.counts(new).tolist(), strict=True))
            look = self.known.__getitem__
            out += [sum(map(look, words)) + (t.count("\n") if self.line_apart else 0) for words, t in zip(cut, texts[a:b], strict=True)]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 tokens); null doc_id is kept; repeated rows are counted each; other columns are ignored; an empty
    table gives an empty one. Texts of any length are counted whole. ``path`` names the model file on every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": np.array(model.count(x["text"].tolist()), dtype=np.int64)})

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.octet_length(body(docs)).cast("long").alias("n_bytes"), body(docs).alias("text"))
    done = rows.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return done.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
