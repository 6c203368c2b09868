"""Ids of texts for a word-end BPE vocabulary: arrays of code points are cut into pre-tokens, each distinct one is encoded once per worker."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex

from groundloom.llm.common import DROPS, SLICE_CHARS, slices
from groundloom.llm.ragged import word_ends

#: The pre-token pattern of the vocabulary file, fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens remembered by a Python worker; beyond that it forgets them all and goes on.
REMEMBERED = 700_000

_gap = re.compile("[\t-\r \x85\xa0  -     　]+")
_blank = _gap.split
_separator = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space, the vocabulary's pattern does not
_odd = re.compile("[^\x00-įı-˿]|<\\|").search  # normalisation changes these, or they may start a special token
_pretokens = regex.compile(PRETOKEN).findall


def chunks(text: str) -> list[str]:
    """The runs of characters that are not white space. No token reaches over white space, and normalisation joins nothing across it."""
    return [c for c in _blank(text) if c] if _separator(text) else text.split()


def odd(chunk: str) -> bool:
    """Whether the chunk needs the library's own normaliser or may hold a special token."""
    return _odd(chunk) is not None


def pretokens(chunk: str) -> list[str]:
    """Pre-tokens of a chunk that is not odd."""
    return _pretokens(chunk.lower())


#: Kinds of characters; from ``TOP`` on all are odd but white space.
LETTER, DIGIT, OTHER, SPACE, ODD = range(5)
TOP = 0x300


def _kind(c: str) -> int:
    if odd(c) or not chunks(c):
        return SPACE if not chunks(c) else ODD
    return LETTER if regex.fullmatch(r"\p{L}", c) else DIGIT if regex.fullmatch(r"\p{N}", c) else OTHER


_kinds = np.array([_kind(chr(c)) for c in range(TOP + 1)], dtype=np.uint8)
_lower = np.array([c if k == ODD else ord(chr(c).lower()) for c, k in enumerate(_kinds)], dtype="<u2")
_wide_spaces = np.array([c for c in range(TOP, 0x3001) if not chunks(chr(c))], dtype="<u4")


def marked(whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of a text between line ends, by character: lower case, kind, whether a pre-token begins; and its odd chunks, each marked as one odd pre-token."""
    points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    low = np.minimum(points, TOP).astype("<u2")
    kind = _kinds[low]
    high = np.flatnonzero(low == TOP)
    kind[high[np.isin(points[high], _wide_spaces)]] = SPACE
    low = _lower[low]
    tags = np.flatnonzero(low == ord("<"))
    strange = np.concatenate((np.flatnonzero(kind == ODD), tags[low[tags + 1] == ord("|")]))
    listed = []
    if len(strange):
        blanks = np.flatnonzero(kind == SPACE)
        k = np.unique(np.searchsorted(blanks, strange))
        first, end = blanks[k - 1] + 1, blanks[k]
        step = np.zeros(len(kind), dtype=np.int8)
        step[first], step[end] = 1, -1
        kind[np.cumsum(step, dtype=np.int8) > 0] = ODD
        listed = [whole[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    begin = np.append(True, kind[1:] != kind[:-1])
    begin |= kind == DIGIT
    begin &= kind != SPACE
    short = np.flatnonzero(low == ord("'"))
    short = short[(kind[short] == OTHER) & (kind[short - 1] != OTHER)]  # within a run of other characters it begins nothing
    a, b = low[short + 1], low[np.minimum(short + 2, len(low) - 1)]
    two = np.isin(a, [ord(c) for c in "stmd"])
    three = np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
    for at, n in ((short[two], 2), (short[three], 3)):
        begin[at + 1] = False
        begin[at + n] |= kind[at + n] == LETTER
    return low, kind, begin, listed


def distinct(data: np.ndarray, begins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different ones of the words that begin at these places of an array of 16-bit characters, and which of them each word is."""
    if not len(begins):
        return [], begins
    edges = np.append(begins, len(data)) * data.itemsize
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    _, ends, held = found.dictionary.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[: len(found.dictionary) + 1]
    text, ends = str(held, "utf-16-le"), (ends // data.itemsize).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])], found.indices.to_numpy()


def stretches(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of whole chunks, of ``most`` characters or little more."""
    at = 0
    while len(text) - at > most and (gap := _gap.search(text, at + most)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class ChunkIds:
    """Texts -> ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        self.model = word_ends(path)
        self.dtype = np.dtype("<u2" if self.model.width <= 1 << 16 else "<u4")
        self.known: dict[str, int] = {}  # the number of each pre-token and odd chunk
        self.parts: list[np.ndarray] = []  # by number: the ids of all one after another, and how many each has

    def forget(self) -> None:
        self.known.clear()
        self.parts.clear()

    def learn(self, new: list[str], plain: int) -> range:
        """Number these; the first ``plain`` are pre-tokens, the others odd chunks."""
        ids, counts = self.model.encode(new[:plain]) if plain else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        others = [self.model.library.encode(c, add_special_tokens=False).ids for c in new[plain:]]
        ids = np.concatenate((ids, np.array([i for x in others for i in x], dtype=np.int64))).astype(self.dtype)
        counts = np.concatenate((counts, np.array([len(x) for x in others], dtype=np.int64)))
        self.parts[:] = [np.concatenate(x) for x in zip(self.parts, (ids, counts), strict=True)] if self.parts else [ids, counts]
        numbers = range(len(self.known), len(self.known) + len(new))
        self.known.update(zip(new, numbers, strict=True))
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [list(stretches(t)) for t in texts]
        flat = [s for x in cut for s in x]
        done = (b for a, e in slices(flat) for b in self._together(flat[a:e]))
        return [b"".join(islice(done, len(x))) for x in cut]

    def _together(self, texts: list[str]) -> list[bytes]:
        low, kind, begin, listed = marked("\n" + "\n".join(texts) + "\n")
        plain = kind < SPACE
        words, which = distinct(low[plain], np.flatnonzero(begin[plain]))
        begins = np.flatnonzero(begin)
        if not len(begins):
            return [b""] * len(texts)
        keys = [*words, *dict.fromkeys(listed)]
        numbers = np.fromiter((self.known.get(k, -1) for k in keys), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(numbers < 0)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            numbers[new] = self.learn([keys[k] for k in new.tolist()], int(np.searchsorted(new, len(words))))
        if listed:
            mixed, own = np.empty(len(begins), dtype=np.int64), plain[begins]
            mixed[own], mixed[~own] = numbers[which], [self.known[c] for c in listed]
        else:
            mixed = numbers[which]
        ids, counts = self.parts
        first, n = np.cumsum(counts) - counts, counts[mixed]
        ends = np.cumsum(n)
        data = ids[np.repeat(first[mixed] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        stops = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
        ends = (np.append(0, ends)[stops] * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    made = ChunkIds(path)
    DROPS[path] = made.forget
    return made
