"""Language identification by mixture inference.

Each language has a distribution over hashed letter trigrams, counted in Spark over the training rows. A document is a mixture of
languages: expectation-maximisation finds the proportions under which its trigrams are likeliest. Starting from all languages the weakest
is dropped as long as the likelihood, penalised by ``PENALTY`` log(trigrams) for each language held, gets better; the set that is left
is the document's. One language alone is kept without iterations where the gradient proves that no mixture can win back the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.llm.common import body, give_back, lean

BUCKETS = 1 << 15
#: Training rows at most, chosen by a hash of the text.
TRAINING_ROWS = 20_000
PENALTY = 4.0
ROUNDS = 40
STEP = 1 << 20


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams (lower case, any other run of characters read as one blank) and how often each occurs."""
    total: np.ndarray | None = None
    low = text.lower()
    for k in range(0, max(1, len(low)), STEP):  # two characters are read again, so that no trigram is lost
        c = np.frombuffer(low[max(0, k - 2) : k + STEP].encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        c = np.where(((c >= 97) & (c <= 122)) | (c >= 0xC0), c, 32)
        if len(c) < 3:
            continue
        g = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * 0x9E3779B1 >> 7 & (BUCKETS - 1)
        g = g[~((c[1:-1] == 32) & ((c[:-2] == 32) | (c[2:] == 32)))]
        if len(low) <= STEP:
            return np.unique(g, return_counts=True)
        counts = np.bincount(g, minlength=BUCKETS)
        total = counts if total is None else total + counts
    if total is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, rows: int = TRAINING_ROWS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of each trigram bucket in each of them, [languages, buckets].

    Learned from text and lang only. About ``rows`` rows with both are used at most (all, if fewer); their counts come back as one sparse
    table of at most ``BUCKETS`` entries for each language. No such row gives no language.
    """
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull())
    n = known.count()
    if not n:
        return [], np.zeros((0, BUCKETS))
    draw = F.pmod(F.xxhash64(known["text"]), F.lit(1_000_000))
    sample = known.where(draw < int(np.ceil(1e6 * min(1.0, rows / n)))).select(known["lang"].alias("lang"), known["text"].alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for x in batches:
            for lang, text in zip(x["lang"], x["text"], strict=True):
                g, c = grams(text)
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen[lang][g] += c
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": c[at]})

    counts = sample.mapInPandas(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).collect()
    found.sort(key=lambda r: r["lang"])
    table = np.full((len(found), BUCKETS), smoothing)
    for k, r in enumerate(found):
        table[k, r["gram"]] += r["n"]
    return [r["lang"] for r in found], table / table.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the likeliest mixture. p: [languages, grams], n: how often each gram occurs."""
    total = n.sum()
    w = np.full(len(p), 1.0 / len(p))
    for _ in range(ROUNDS if len(p) > 1 else 0):
        new = w * (p @ (n / (w @ p))) / total
        moved = np.abs(new - w).max()
        w = new
        if moved < 1e-4:
            break
    return w, float(n @ np.log(w @ p))


def infer(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions of all languages; zero for those outside the selected set."""
    price = PENALTY * np.log(1 + n.sum())
    single = np.log(p) @ n
    best = int(single.argmax())
    out = np.zeros(len(p))
    # by concavity no mixture gains more than the steepest direction promises
    if ((p / p[best]) @ n).max() - n.sum() <= price:
        out[best] = 1.0
        return out
    held = np.arange(len(p))
    kept = (np.ones(1), np.array([best]), float(single[best]) - price)
    while len(held) > 1:
        w, fit = mixture(p[held], n)
        if fit - price * len(held) > kept[2]:
            kept = (w, held, fit - price * len(held))
        held = np.delete(held, int(w.argmin()))
    out[kept[1]] = kept[0] / kept[0].sum()
    return out


SHARES = "array<struct<lang:string,share:double>>"


def judged(texts: pd.Series, model: tuple[list[str], np.ndarray]) -> pd.DataFrame:
    """lang_pred, score and languages of each text."""
    names, table = model
    pred, score, sets = [], [], []
    for text in texts:
        w = np.zeros(0)
        if names and has_letter(text):
            g, n = grams(f" {text} ")
            w = infer(table[:, g], n.astype(np.float64)) if len(g) else w
        order = [k for k in np.argsort(-w, kind="stable").tolist() if w[k] > 0]
        pred.append(names[order[0]] if order else "und")
        score.append(float(min(1.0, w[order[0]])) if order else 0.0)
        sets.append([{"lang": names[k], "share": float(w[k])} for k in order])
    return pd.DataFrame({"lang_pred": pred, "score": score, "languages": sets})


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and languages (name and proportion of each in the selected set, largest first) for every row of ``docs``.

    lang_pred has the largest proportion, which is the score; ties go to the first name. Texts that are null or without a letter, and
    all texts if no language was learned, are ``und`` with score 0. Only text is read; repeated rows are judged each; an empty table
    gives an empty one. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield judged(x["text"], model).assign(doc_id=x["doc_id"].to_numpy(dtype=object))[["doc_id", "lang_pred", "score", "languages"]]

    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), body(docs).alias("text"))
    done = rows.mapInPandas(lean(run), f"doc_id string, lang_pred string, score double, languages {SHARES}")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language that makes up ``least`` of the text or more, all columns as they are."""

    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        give_back()
        found = judged(texts, model)
        return (found["lang_pred"] != "und") & (found["score"] >= least)

    return docs.where(clear(body(docs)))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
