"""Quality scores from a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled documents, every path from a root becomes a
conjunctive rule, a lasso logistic regression weighs the rules, and those that keep a weight are compiled to one
Spark column.  Scoring is a projection: no Python, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborbook.llm.texts import held_out

#: Labelled documents learned from at most, those with the smallest hash of their id; all that reaches the driver.
SAMPLE = 20_000
TREES, DEPTH, CUTS, SHRINK = 24, 3, 24, 0.3
LASSO = 0.0005

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null or empty text has 0 in all of them.  Expressions refer to each other by name."""
    text = F.coalesce(text, F.lit(""))

    def share(pattern: str) -> Column:
        return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))

    words, lines = F.filter(F.split(text, "\\s+"), lambda w: w != ""), F.split(text, "\n")
    return {
        "_chars": F.length(text).cast("double"),
        "_words": words,
        "_lines": lines,
        "_letters": F.when(text == "", 0.0).otherwise(share("\\p{L}+")),
        "_upper": F.when(text == "", 0.0).otherwise(share("\\p{Lu}+")),
        "_digits": F.when(text == "", 0.0).otherwise(share("\\p{N}+")),
        "_symbols": F.when(text == "", 0.0).otherwise(share("[^\\p{L}\\p{N}\\s.,;:'\"!?()-]+")),
        "_marks": F.when(text == "", 0.0).otherwise(share("[!?]+")),
        "_stops": F.when(text == "", 0.0).otherwise(share("[.,;:]+")),
    }


def derived() -> dict[str, Column]:
    """The statistics made from the word and line lists of ``statistics``."""
    n, m = F.size("_words"), F.size("_lines")
    some, long = F.greatest(n, F.lit(1)), F.filter("_lines", lambda x: F.length(x) > 20)
    return {
        "_n_words": n.cast("double"),
        "_word_length": F.col("_chars") / some,
        "_distinct": F.size(F.array_distinct("_words")) / some,
        "_n_lines": m.cast("double"),
        "_line_length": F.col("_chars") / F.greatest(m, F.lit(1)),
        "_line_copies": 1 - F.size(F.array_distinct(long)) / F.greatest(F.size(long), F.lit(1)),
        "_longest": F.coalesce(F.array_max(F.transform("_words", lambda w: F.length(w))), F.lit(0)).cast("double"),
    }


FEATURES = (
    "_chars", "_letters", "_upper", "_digits", "_symbols", "_marks", "_stops",
    "_n_words", "_word_length", "_distinct", "_n_lines", "_line_length", "_line_copies", "_longest",
)


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and the columns ``FEATURES``."""
    out = docs.select("*", *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    return out.select("*", *[c.alias(n) for n, c in derived().items()]).drop("_words", "_lines")


@dataclass(frozen=True)
class RuleModel:
    """``score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))``."""

    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """The model as a column over ``FEATURES``."""

        def holds(rule: Rule) -> Column:
            return reduce(and_, [F.col(f) <= F.lit(cut) if low else F.col(f) > F.lit(cut) for f, low, cut in rule])

        weights = [F.when(holds(rule), F.lit(weight)).otherwise(0.0) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(add, weights, F.lit(self.bias))))


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, path: tuple, out: list) -> np.ndarray:
    """Split ``rows`` where the squared error of ``grad`` falls most; paths go to ``out``; returns the fitted values."""
    fit = np.full(len(grad), 0.0)
    if path:
        out.append(path)
    best = (1e-9, None, None)
    if len(path) < DEPTH and len(rows) >= 20:
        total, n = grad[rows].sum(), len(rows)
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            place = np.searchsorted(at, x[rows, j], side="left")  # value <= at[k] exactly if place <= k
            count = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
            below = np.cumsum(np.bincount(place, grad[rows], len(at) + 1))[:-1]
            ok = (count >= 10) & (n - count >= 10)
            gain = np.where(ok, below**2 / np.maximum(count, 1) + (total - below) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
    if best[1] is None:
        fit[rows] = grad[rows].mean() if len(rows) else 0.0
        return fit
    _, j, cut = best
    low = x[rows, j] <= cut
    return (
        _grow(x, cuts, grad, rows[low], (*path, (FEATURES[j], True, cut)), out)
        + _grow(x, cuts, grad, rows[~low], (*path, (FEATURES[j], False, cut)), out)
    )


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty by accelerated proximal steps; the bias is free."""
    z1 = np.column_stack([np.ones(len(y)), z])
    step = 4 * len(y) / max(np.linalg.norm(z1.T @ z1, 2), 1e-9)
    w = v = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(rounds):
        gradient = z1.T @ (1 / (1 + np.exp(-np.clip(z1 @ v, -35, 35))) - y) / len(y)
        new = v - step * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Grow trees, take their paths as rules, keep those with a weight.  One class, or no row, gives a constant."""
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) < 40 or len(np.unique(y)) < 2:
        return RuleModel(bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    margin, paths = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + SHRINK * 4 * _grow(x, cuts, y - p, np.arange(len(y)), (), paths)
    rules = sorted(set(paths))
    at = {f: j for j, f in enumerate(FEATURES)}
    z = np.column_stack([np.logical_and.reduce([(x[:, at[f]] <= c) == low for f, low, c in r]) for r in rules]).astype(float)
    bias, weights = _lasso(z, y, LASSO)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fit on at most ``sample`` labelled documents that are not held out.

    Of several labels of an id the smallest counts, null labels and ids do not; of several texts of an id the one with the
    least hash is learned, so ``sample`` also bounds the rows that reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    pairs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    pairs = pairs.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = with_statistics(pairs, "_text").select("_label", *FEATURES).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), 1 + len(FEATURES))
    data = data[np.lexsort(data.T)]  # the order in which rows arrive must not matter
    return fit_rules(data[:, 1:], data[:, 0])


def score_quality(docs: DataFrame, model: RuleModel, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in column ``into`` (which replaces one of that name).

    Null and empty texts are scored like any other, from statistics of 0.  Columns beginning with ``_`` that clash with
    the statistics are kept.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)
    scored = with_statistics(numbered, names[docs.columns.index(text)]).withColumn("_score", model.score())
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != into]
    return scored.select(*kept, F.col("_score").alias(into))
