"""Secret scan: candidates by pattern, false positives removed by a random forest, in DataFrame functions throughout.

Every long run of key characters with a digit is proposed, and every one without that is assigned to a secret word. Its features are length, changes between character
classes, dictionary coverage, path marks and the words beside it. Trees are grown level by level for the whole forest: one aggregation
counts labelled rows by tree, node, feature and bin, a table of fixed size, from which the driver takes the splits. The finished forest
is a literal table that ``aggregate`` walks.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from groundloom.llm.common import body
from groundloom.session import cut_lineage

#: Only tried at the start of a run, so that long runs cost no more than their length.
HAS_RUN = r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+.@-]*+[0-9])[A-Za-z0-9_/+.@-]{10,}+"
RUN = r"(?<![A-Za-z0-9_/+.@-])[A-Za-z0-9_/+.@-]{10,}+"
SECRET_NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|key|auth|credentials?)[\"']?\s*[:=]+>?\s*[\"']?"
SPEAKS_FOR = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|credential|private|bearer)"
SPEAKS_AGAINST = r"(?i)(sha\d*|md5|commit|checksum|digest|uuid|version|example|sample|dummy|card|phone|mail|http|www|order|isbn)"
PATHLIKE = r"(^|[A-Za-z0-9])[/.][A-Za-z]|@"
CHANGES = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
FEATURES = ("length", "digit_share", "upper_share", "changes", "variety", "hex", "coverage", "path", "word_for", "word_against", "assigned")
#: Formats that providers publish, and shapes that are no secrets: they label findings where nobody has. Fixed values.
KNOWN_SECRET = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})$"
ASSIGNED = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?$"
KNOWN_HARMLESS = r"^([0-9]+|[0-9]+(\.[0-9]+){3}|[0-9.+-]+|[^@]+@[^@]+\.[A-Za-z]+|[0-9]{4}-[0-9]{2}-[0-9]{2}.*)$"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index (place among the white-space tokens), run_index (place among the token's runs of ten or more key characters), value, before, after.

    All runs with a digit are proposed, and those without that follow a secret's name and a colon or equals sign. Before the first run of
    a token stand the three tokens before it and what precedes it in its own; before a further one, the run before and what is between.
    After the last stand the three tokens after it; after another, what is up to the next run. Null text has none.
    """
    named = SECRET_NAME + RUN.replace(r"(?<![A-Za-z0-9_/+.@-])", "")
    d = docs.select(docs["doc_id"], body(docs).alias("t"))
    d = d.select("doc_id", "t", F.col("t").rlike(named).alias("named")).where(F.col("named") | F.col("t").rlike(HAS_RUN))
    d = d.select("doc_id", "named", F.split("t", r"\s+").alias("w"))
    near = lambda s: F.concat_ws(" ", F.get("w", s["i"] - 2), F.get("w", s["i"] - 1), s["x"])
    tokens = F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hits = F.filter(tokens, lambda s: s["x"].rlike(HAS_RUN) | (F.col("named") & s["x"].rlike(RUN) & near(s).rlike(named)))
    d = d.select("doc_id", "w", F.explode(hits).alias("h"))
    d = d.select(
        "doc_id",
        F.col("h.i").cast("long").alias("word_index"),
        F.regexp_extract_all("h.x", F.lit(f"({RUN}={{0,2}})"), 1).alias("v"),
        F.split("h.x", f"{RUN}={{0,2}}").alias("between"),
        F.slice("w", F.greatest(F.col("h.i") - 2, F.lit(1)), F.least(F.col("h.i"), F.lit(3))).alias("left"),
        F.concat_ws(" ", F.slice("w", F.col("h.i") + 2, F.lit(3))).alias("right"),
    )

    def run(v: Column, k: Column) -> Column:
        before = F.when(k == 0, F.concat_ws(" ", "left", F.get("between", k))).otherwise(F.concat(F.get("v", k - 1), F.get("between", k)))
        after = F.when(k == F.size("v") - 1, F.col("right")).otherwise(F.get("between", k + 1))
        return F.struct(k.cast("long").alias("run_index"), v.alias("value"), before.alias("before"), after.alias("after"))

    proposed = F.filter(F.transform("v", run), lambda r: r["value"].rlike(HAS_RUN) | r["before"].rlike(SECRET_NAME + "$"))
    return d.select("doc_id", "word_index", F.explode(proposed).alias("r")).select("doc_id", "word_index", "r.*")


def dictionary(docs: DataFrame, least: int = 3) -> DataFrame:
    """Words of three or more letters, without a digit beside them, that at least ``least`` documents hold: ordinary words of this corpus."""
    found = F.regexp_extract_all(F.lower(body(docs)), F.lit(r"(?<![\p{L}0-9_])\p{L}{3,}+(?![0-9_])"), 0)
    words = docs.select(F.explode(F.array_distinct(found)).alias("piece"))
    return words.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("piece")


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` with x, the array of FEATURES; coverage by the words of all ``docs``."""
    v = F.col("value")
    n = F.length("value").cast("double")
    without = lambda p: n - F.length(F.regexp_replace("value", p, ""))
    # coverage: letters of the value's runs that are dictionary words, over its length
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}"), 0)).alias("piece"))
    covered = runs.join(dictionary(docs), "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("covered")).withColumnRenamed("value", "_value")
    joined = found.join(covered, v == F.col("_value"), "left")
    one = lambda c: c.cast("double")
    x = F.array(
        n,
        without("[0-9]") / n,
        without("[A-Z]") / n,
        F.length(F.regexp_replace("value", CHANGES, "~")) - n,
        F.size(F.array_distinct(F.split("value", ""))) / n,
        one(v.rlike("^[0-9a-fA-F]+$")),
        F.coalesce(F.col("covered"), F.lit(0)) / n,
        one(v.rlike(PATHLIKE)),
        one(F.col("before").rlike(SPEAKS_FOR)),
        one(F.concat_ws(" ", "before", "after").rlike(SPEAKS_AGAINST)),
        one(F.col("before").rlike(r"[:=][\"'\s]*$")),
    )
    return joined.select(*found.columns, x.alias("x"))


def weak_labels() -> Column:
    """1 for published formats and assigned values, 0 for known harmless shapes, null for the rest."""
    return F.when(F.col("value").rlike(KNOWN_SECRET), 1).when(F.col("value").rlike(KNOWN_HARMLESS), 0).when(F.col("before").rlike(ASSIGNED), 1)


@dataclass
class Forest:
    """Complete binary trees of one depth: node 1 is the root, node k goes to 2 k, or to 2 k + 1 where the feature is at least the cut."""

    depth: int
    feature: list[list[int]] = field(default_factory=list)
    cut: list[list[float]] = field(default_factory=list)
    leaf: list[list[float]] = field(default_factory=list)

    def node(self, tree: Column, x: Column, level: int) -> Column:
        f, c = F.get(F.lit(self.feature), tree), F.get(F.lit(self.cut), tree)
        step = lambda k, _: k * 2 + F.when(F.get(x, F.get(f, k)) >= F.get(c, k), 1).otherwise(0)
        return F.aggregate(F.sequence(F.lit(1), F.lit(level)), F.lit(1), step) if level else F.lit(1)

    def score(self, x: Column) -> Column:
        """Mean share of positive rows in the leaves that x reaches."""
        if not self.leaf:
            return F.lit(1.0)
        trees = F.sequence(F.lit(0), F.lit(len(self.leaf) - 1))
        leaves = F.transform(trees, lambda t: F.get(F.get(F.lit(self.leaf), t), self.node(t, x, self.depth) - (1 << self.depth)))
        return F.aggregate(leaves, F.lit(0.0), lambda a, p: a + p) / len(self.leaf)


def train(found: DataFrame, label: Column, trees: int = 15, depth: int = 4, bins: int = 16, max_rows: int = 20_000, seed: int = 7) -> Forest:
    """A forest fitted on labelled findings (``features`` rows where ``label`` is 0 or 1; about ``max_rows`` at most, by a hash of the finding).

    Rows count 0, 1 or 2 times in a tree, by a hash, and each node looks at a random third of the features. Without both classes among
    the labels the forest is empty and scores every finding 1.
    """
    rows = found.select("x", label.alias("y"), F.xxhash64("doc_id", "word_index", "value").alias("id")).where("y is not null")
    n = rows.count()
    draw = F.pmod(F.col("id"), F.lit(1_000_000))
    rows = cut_lineage(rows.where(draw < F.lit(math.ceil(1e6 * min(1.0, max_rows / max(n, 1))))))
    forest = Forest(depth)
    if rows.select("y").distinct().count() < 2:
        return forest
    share = [(i + 1) / bins for i in range(bins - 1)]
    cuts = rows.agg(*[F.percentile(F.get("x", F.lit(k)), F.lit(share)) for k in range(len(FEATURES))]).first()
    steps = [sorted({*c, 0.5}) for c in cuts]
    binned = F.transform("x", lambda v, k: F.size(F.filter(F.get(F.lit(steps), k), lambda c: c <= v)))
    rows = cut_lineage(rows.select("x", "y", "id", binned.alias("b")))
    width = 1 << depth
    forest.feature, forest.cut = [[0] * width for _ in range(trees)], [[math.inf] * width for _ in range(trees)]
    grown = rows.select("x", "y", "b", "id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    grown = grown.withColumn("w", F.pmod(F.xxhash64("id", "tree"), F.lit(3))).where("w > 0")
    for level in range(depth):
        at = grown.select("tree", forest.node(F.col("tree"), F.col("x"), level).alias("node"), "y", "w", F.posexplode("b").alias("f", "bin"))
        counts = at.groupBy("tree", "node", "f", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
        by: dict[tuple[int, int], dict[int, dict[int, tuple[int, int]]]] = {}
        for r in counts:
            by.setdefault((r["tree"], r["node"]), {}).setdefault(r["f"], {})[r["bin"]] = (r["n"], r["p"])
        for (tree, node), hist in by.items():
            pick = random.Random(f"{seed} {tree} {node}").sample(range(len(FEATURES)), max(1, round(len(FEATURES) / 3)))
            if split := _best_split({f: hist[f] for f in pick if f in hist}, steps):
                forest.feature[tree][node], forest.cut[tree][node] = split
    ends = grown.select("tree", forest.node(F.col("tree"), F.col("x"), depth).alias("node"), "y", "w").groupBy("tree", "node").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
    forest.leaf = [[0.5] * width for _ in range(trees)]
    for r in ends:
        forest.leaf[r["tree"]][r["node"] - width] = r["p"] / r["n"]
    return forest


def _best_split(hist: dict[int, dict[int, tuple[int, int]]], steps: list[list[float]]) -> tuple[int, float] | None:
    """Feature and cut of the lowest Gini impurity; None where nothing improves on the whole."""
    impurity = lambda n, p: 2 * p * (n - p) / n if n else 0.0
    best: tuple[float, tuple[int, float] | None] = (math.inf, None)
    for f, bins in sorted(hist.items()):
        n, p = (sum(x[i] for x in bins.values()) for i in (0, 1))
        a = b = 0
        for k, cut in enumerate(steps[f]):
            a, b = a + bins.get(k, (0, 0))[0], b + bins.get(k, (0, 0))[1]
            left = impurity(a, b) + impurity(n - a, p - b)
            if 0 < a < n and left < min(best[0], impurity(n, p)) - 1e-9:
                best = (left, (f, cut))
    return best[1]


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, word_index, run_index, value, score and kept (score at least ``least``) for every proposed secret.

    ``labelled`` (doc_id, word_index, y, and run_index where single runs are judged) holds judged findings; without it published formats and known harmless shapes are the labels.
    Null texts have no findings; repeated rows are scanned each; null ids are kept; other columns are ignored; an empty table
    gives no findings.
    """
    found = cut_lineage(features(cut_lineage(candidates(docs)), docs))
    if labelled is None:
        forest = train(found, weak_labels())
    else:
        keys = [k for k in ("doc_id", "word_index", "run_index") if k in labelled.columns]
        judged = labelled.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("y").alias("_y"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        forest = train(found.join(judged, same), F.col("_y"))
    return found.withColumn("score", forest.score(F.col("x"))).select("doc_id", "word_index", "run_index", "value", "score", (F.col("score") >= least).alias("kept"))
