"""A sparse rule ensemble for quality.

Boosted trees over text statistics give paths, each a conjunction of
thresholds; logistic regression with a lasso penalty weighs them, and those
with weight are compiled into one Spark expression. The statistics are Spark
expressions as well, so scoring never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtok.llm.common import WORD, crc_mod
from loomtok.llm.labelled import FOLDS, SAMPLE, labelled_sample

THRESHOLD, TREES, DEPTH, BINS = 0.3, 40, 3, 48


def counts(text: Column) -> dict[str, Column]:
    """What is counted in a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    patterns = {"words": WORD, "upper": "[A-Z]", "shouted": "[A-Z]{2}", "digits": "[0-9]", "symbols": r"[#*$%&|<>]", "bangs": "!", "stops": "[.?]", "commas": ","}
    lines = F.split(t, "\n")
    sizes = {"chars": F.length(t), "lines": F.size(lines), "kinds_of_lines": F.size(F.array_distinct(lines)), "kinds_of_words": F.size(F.array_distinct(F.split(t, " ")))}
    return {**{k: F.regexp_count(t, F.lit(p)) for k, p in patterns.items()}, **sizes}


def ratios(c: dict[str, Column]) -> dict[str, Column]:
    """The statistics that rules put thresholds on, from counts()."""
    n = c["words"] + 1
    per = {k: c[k] / n for k in ("upper", "shouted", "digits", "symbols", "bangs", "stops", "commas", "lines")}
    return {"log_words": F.log1p(c["words"]), "word_chars": c["chars"] / n, **per, "same_lines": c["kinds_of_lines"] / c["lines"], "same_words": c["kinds_of_words"] / n}


NAMES = ("log_words", "word_chars", "upper", "shouted", "digits", "symbols", "bangs", "stops", "commas", "lines", "same_lines", "same_words")


def statistics(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and the statistics under __ and their names.

    Counts are made once each, in a projection. The ratios come out of a
    generator, since a filter on them would else be pushed below and repeat
    every count in every rule.
    """
    made = counts(F.col("text"))
    rows = rows.select(*keep, *(c.alias(f"__n_{k}") for k, c in made.items()))
    found = ratios({k: F.col(f"__n_{k}") for k in made})
    return rows.select(*keep, F.inline(F.array(F.struct(*(found[k].alias(f"__{k}") for k in NAMES)))))


Condition = tuple[int, bool, float]  # feature, above the threshold, threshold


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], out: list) -> None:
    """Splits on binned features by second-order gain; out gets (path, value) of every leaf, paths the conditions."""
    best = (1e-6, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if len(path) < DEPTH and len(rows) >= 40:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.bincount(x[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
            hs = np.bincount(x[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
            n = np.bincount(x[rows, j], minlength=len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(n < 15) | (len(rows) - n < 15)] = 0
            if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        out.append((path, rows, total_g / (total_h + 1)))
        return
    j, k = best[1]
    above = x[rows, j] > k
    for side in (False, True):
        _tree(x, cuts, g, h, rows[above == side], (*path, (j, side, float(cuts[j][k]))), out)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[frozenset[Condition]]:
    """The paths, and their beginnings, of boosted trees."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        _tree(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), (), leaves)
        for path, rows, value in leaves:
            margin[rows] += 0.3 * value
            for k in range(1, len(path) + 1):
                rules[frozenset(path[:k])] = None
    return list(rules)


def holds(rule: frozenset[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on 0/1 columns; the intercept isn't penalised."""
    n, k = z.shape
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        to = v - step * (z.T @ r) / n
        new_w, new_b = np.sign(to) * np.maximum(np.abs(to) - step * penalty, 0), c - step * r.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new_w + (last - 1) / t * (new_w - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return b, w


@dataclass
class RuleEnsemble:
    names: list[str]
    intercept: float
    rules: list[tuple[frozenset[Condition], float]]

    def column(self) -> Column:
        """The probability of label 1 as an expression over columns of these names."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for j, above, cut in sorted(rule):
                met = met & (F.col(self.names[j]) > cut if above else F.col(self.names[j]) <= cut)
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", penalty: float = 0.0005, most: int = SAMPLE) -> RuleEnsemble:
    """Fits on labelled_sample(). With no labels, or one class, the score is a smoothed share of label 1."""
    names = [f"__{n}" for n in NAMES]
    rows = statistics(labelled_sample(docs, labels, label, most), "doc_id", "y").toPandas()
    rows = rows.sort_values(["doc_id", *names])  # the same fit whatever the order of arrival
    x, y = rows[names].to_numpy(float).reshape(-1, len(names)), rows.y.to_numpy(float)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 50 or y.min() == y.max():
        return RuleEnsemble(names, float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    b, w = lasso_logistic(np.stack([holds(r, x) for r in rules], 1).astype(float), y, penalty)
    return RuleEnsemble(names, float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs' own columns, and score and predicted (which replace columns of those names)."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = statistics(docs, *kept).select(*kept, model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows of docs, with their own columns whatever their names, that the model predicts to be of label 1."""
    rows = statistics(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")), "__doc")
    return rows.where(model.column() >= THRESHOLD).select("__doc.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts are scored as empty; rows with one id are scored each;
    a null id counts as the empty text in the fold; no rows give no rows; of
    docs only doc_id and text are read.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
