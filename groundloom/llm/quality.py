"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditions.

``statistics`` describes each text by built-in functions only, without a shuffle. ``learn`` grows and prunes conjunctions of threshold
tests on the labelled rows: every step is one aggregation that counts good and bad rows by feature and bin, a table of fixed size. ``verdict``
turns the list into CASE WHEN, first match first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from groundloom.llm.common import body, let
from groundloom.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("n_words", "mean_word", "symbol_rate", "bang_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate", "distinct_rate")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.value) if self.above else c < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:g}"


Rule = tuple[Test, ...]


def _removed(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: windows sorted by (hash, place), marked by their neighbours."""

    def marked(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        hit = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
        return F.sort_array(F.transform(hit, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda p: let(marked(p), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` (the whole input row) and the statistics of its text.

    Null text counts as empty: all counts 0, base_failed. Rows are described one by one, so ties, repeated rows and null ids need no
    care; other columns, also of clashing names, stay inside ``row``; an empty table gives an empty one. Work per text is
    proportional to n log n at most.
    """
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.trim(body(docs), F.lit(BLANKS)).alias("t"), body(docs).alias("whole"))
    d = d.select("row", "t", "whole", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", r"[\x20\x09-\x0D]+")).alias("w"))
    d = d.select(
        "row",
        "t",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.filter(F.split("whole", "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    first = F.slice("h", F.lit(1), F.greatest(F.size("h") - F.lit(WINDOW - 1), F.lit(0)))
    d = d.select(
        "row",
        "n_words",
        "word_chars",
        "n_distinct",
        (F.length("t") - F.length(_removed(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).alias("n_bangs"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", "[0-9]+", ""))).alias("n_digits"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + F.lit(k)) for k in range(1, WINDOW)])).alias("g"),
    )
    repeats = F.when(F.size(F.array_distinct("g")) < F.size("g"), _repeat_words(F.col("g"))).otherwise(F.lit(0).cast("long"))
    counts = [c for c in d.columns if c not in ("row", "g")]
    # one row in, one out; a filter on a count stays above the generator instead of being pushed down with its whole expression inside
    d = d.select("row", F.inline(F.array(F.struct(*counts, repeats.alias("n_repeat_words")))))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    return d.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbol_rate"),
        share("n_bangs", "n_words").alias("bang_rate"),
        share("n_upper", "word_chars").alias("upper_rate"),
        share("n_digits", "word_chars").alias("digit_rate"),
        share("n_dup_lines", "n_lines").alias("dup_line_rate"),
        share("n_repeat_words", "n_words").alias("repeat_rate"),
        share("n_distinct", "n_words").alias("distinct_rate"),
        ((F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))).alias("base_failed"),
    )


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, bins: int = 64, max_rules: int = 8, max_tests: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Rules that reject, in order, learned from ``labels`` (doc_id, quality 0 or 1).

    The classifier is fitted on about ``max_rows`` labelled rows at most, chosen by a hash of doc_id; all else bounds the list: thresholds
    are ``bins`` exact quantiles of each feature, ``max_rules`` rules of ``max_tests`` tests. Rows that fail the base rules teach nothing.
    A rule is grown on two thirds of the rows by information gain, pruned on the last third, and kept while its precision there is at least
    ``precision`` on ``least`` rows. Null labels and ids are left out; no labels give no rules.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("k"), (F.col("quality") == 0).cast("int").alias("bad"))
    n = known.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.col("k"), F.lit(17)), F.lit(1_000_000))
    known = known.where(draw < F.lit(math.ceil(1e6 * min(1.0, max_rows / n))))
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["k"]).select(F.struct(docs["doc_id"], known["bad"], docs["text"]).alias("x"))
    s = statistics(rows.select("x.doc_id", "x.text", "x.bad")).where(~F.col("base_failed"))
    prune = F.pmod(F.xxhash64(F.col("row.doc_id"), F.lit(29)), F.lit(3)) == 0
    train = cut_lineage(s.select(F.col("row.bad").alias("bad"), prune.alias("prune"), *[F.col(f).cast("double").alias(f) for f in FEATURES]))
    cuts = train.agg(*[F.percentile(f, F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])).alias(f) for f in FEATURES]).first()
    if cuts is None or cuts[0] is None:
        return []
    steps = {f: sorted(set(cuts[f])) for f in FEATURES}
    of = lambda f: F.size(F.filter(F.array(*[F.lit(v) for v in steps[f]]), lambda v: v <= F.col(f)))
    binned = cut_lineage(train.select("*", F.array(*[of(f) for f in FEATURES]).alias("bin")))

    def grow(left: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < max_tests:
            counts = left.select("bad", F.posexplode("bin").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
            best, gain = _best_test(counts, steps)
            if best is None or gain <= 0:
                break
            rule, left = (*rule, best), left.where(best.column())
        return rule

    rules: list[Rule] = []
    while len(rules) < max_rules:
        open_rows = binned.where(~_any(rules))
        rule = grow(open_rows.where(~F.col("prune")))
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        found = open_rows.where("prune").agg(*[F.sum(F.when(_all(h), v).otherwise(0)) for h in heads for v in (F.col("bad"), F.lit(1))]).first()
        scored = [((found[2 * k] or 0), (found[2 * k + 1] or 0), h) for k, h in enumerate(heads)]
        bad, all_, rule = max(scored, key=lambda x: ((x[0] / x[1]) if x[1] else 0.0, x[0], -len(x[2])))
        if bad < least or bad < precision * all_:
            break
        rules.append(rule)
    return rules


def _best_test(counts: list, steps: dict[str, list[float]]) -> tuple[Test | None, float]:
    """The threshold test of the highest information gain (covered bad rows times the bits saved on each)."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["bad"], r["n"])
    best: tuple[float, Test | None] = (0.0, None)
    for f, name in enumerate(FEATURES):
        bins = by.get(f, {})
        total = [sum(x[i] for x in bins.values()) for i in (0, 1)]
        if not total[0] or total[0] == total[1]:
            continue
        start = math.log2(total[0] / total[1])
        low = [0, 0]
        for k, value in enumerate(steps[name]):
            low = [low[i] + bins.get(k, (0, 0))[i] for i in (0, 1)]
            for above, (bad, n) in ((False, low), (True, [total[0] - low[0], total[1] - low[1]])):
                if bad and n < total[1] and (gain := bad * (math.log2(bad / n) - start)) > best[0] + 1e-9:
                    best = (gain, Test(name, above, value))
    return best[1], best[0]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row (from 1), 0 where none does."""
    if not rules:
        return F.lit(0)
    out = F.when(_all(rules[0]), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        out = out.when(_all(r), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``statistics`` with ``rule`` (0: none) and ``kept``."""
    s = statistics(docs).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
