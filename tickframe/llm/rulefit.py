"""Quality scores from a sparse rule ensemble, compiled into Spark column expressions.

Paths of shallow trees become conjunctive rules over text statistics, a lasso logistic
regression keeps few of them, and the kept ones become one column expression that scores
any number of rows inside generated code (RuleFit, Friedman and Popescu 2008).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.neardup import written

#: Labelled rows the ensemble is fitted on: those with the smallest hashes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 20, 3, 0.002, 11
#: Score from which a text counts as good.
THRESHOLD = 0.3


STATISTICS = [
    "words", "word_length", "symbol_share", "pipe_share", "loud_share", "stop_share", "digit_share",
    "capital_share", "line_length", "distinct_lines", "distinct_words",
]


def statistics(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and the ``STATISTICS`` of each whole text.

    A null text is an empty one, and shares of nothing are 0. What is not a small letter or
    a blank is picked out first, so that counting its kinds goes over little text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        *keep,
        F.length(text).alias("_chars"),
        F.translate(text, " \nabcdefghijklmnopqrstuvwxyz", "").alias("_marks"),
        F.split(text, "\n").alias("_lines"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
    )
    solid = F.length(F.array_join("_words", ""))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    marks = lambda pattern, of: share(F.regexp_count("_marks", F.lit(pattern)), of)
    chars, words, lines = F.col("_chars"), F.size("_words"), F.size("_lines")
    found = [
        words.cast("double"),
        share(solid, words),
        marks(r"[#*$%&|<>]", chars),
        marks(r"[|]", chars),
        marks(r"[!?]", chars),
        marks(r"[.,;:]", chars),
        marks(r"[0-9]", chars),
        marks(r"\p{Lu}", chars),
        share(chars, lines),
        share(F.size(F.array_distinct("_lines")), lines),
        share(F.size(F.array_distinct("_words")), words),
    ]
    return parts.select(*keep, *(c.alias(n) for n, c in zip(STATISTICS, found, strict=True)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds ``low < statistic <= high``."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out &= F.col(name) > low
            if high < math.inf:
                out &= F.col(name) <= high
        return out


@dataclass
class Ensemble:
    """Weighted rules: the score is the logistic function of their sum."""

    intercept: float = 0.0
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """The score over the statistics' columns, as one expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total += F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


_SPLIT = re.compile(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(description: str, names: list[str]) -> set[Rule]:
    """A rule for every node below the root of a printed tree: the conjunction on the way to it."""
    rules, path = set(), []
    for line in description.splitlines():
        found = _SPLIT.search(line)
        if not found:
            continue
        depth = len(line) - len(line.lstrip())
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, names[int(found[1])], found[2], float(found[3])))
        bounds = {}
        for _, name, side, at in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
        rules.add(Rule(tuple((n, *bounds[n]) for n in sorted(bounds))))
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> Ensemble:
    """Rules and weights from the labelled rows with the smallest hashes, ``sample_rows`` at most.

    Labels are 0 or 1; others, null labels and null ids are left out. An id with several
    labels counts once per distinct label. Without labels every score is 0.5, with one label
    only it is that label.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .where("_id is not null and _label in (0.0, 1.0)")
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the sample is bounded, so it may be broadcast
    sample = statistics(texts.join(F.broadcast(chosen), "_id"), "_text", "_id", "_label")
    sample = written(sample.repartition(1).sortWithinPartitions("_id", "_label", *STATISTICS), "sample").cache()
    seen = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    if len(seen) < 2:
        sample.unpersist()
        return Ensemble({0.0: -40.0, 1.0: 40.0}.get(next(iter(seen), None), 0.0))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="_label", featureSubsetStrategy="onethird", maxBins=64
    ).fit(vectors)
    rules = set().union(*(tree_rules(t.toDebugString, STATISTICS) for t in forest.trees))
    rules = sorted(rules, key=lambda r: r.bounds)
    if not rules:
        sample.unpersist()
        return Ensemble(math.log(seen[1.0] / seen[0.0]))
    indicators = F.array(*(r.column().cast("double") for r in rules))
    hits = sample.select("_label", array_to_vector(indicators).alias("features"))
    lasso = LogisticRegression(
        labelCol="_label", regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=100
    ).fit(hits)
    sample.unpersist()
    kept = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w != 0.0}
    return Ensemble(float(lasso.intercept), kept)


def scored(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted of every row; nothing but the text enters the score."""
    score = statistics(docs, text_col, id_col).select(F.col(id_col), ensemble.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Fit on the labelled rows and score all rows: ``id_col``, score (0 to 1), predicted (0 or 1).

    Null and empty texts are scored like any other, by statistics of nothing; repeated rows
    and null ids come back as they are; other columns are not read.
    """
    return scored(docs, fit(docs, labels, id_col, text_col, label_col, sample_rows), id_col, text_col)
