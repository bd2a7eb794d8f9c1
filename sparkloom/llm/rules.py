"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of a text are Spark column expressions. Boosted trees of small depth are fitted to a sample of labelled
rows; the path to each of their nodes is a conjunctive rule; a lasso logistic regression picks and weighs few of the
rules; the chosen rules compile back into one Spark column expression, so scoring all texts is a single pass of built-in
functions without a shuffle.

The sample has at most `max_sample` labelled rows (by a hash of doc_id, so the choice does not depend on order); all
else reads every row. Labels, language, source and doc_id are no inputs of a score.

Defined results: null text is the empty text, whose statistics are all 0, so it gets the score of that point; equal
doc_ids are scored row by row; labels without a quality or a document are ignored; without any labelled row (or with one
class only) the score is the share of 1 among the labels, 0.5 without labels; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

MAX_SAMPLE = 20_000
THRESHOLD = 0.3

Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, at most) of each condition, by statistic


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _lost(text: Column, pattern: str) -> Column:
    """Characters that go when all matches go."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(docs: DataFrame, **more: Column) -> tuple[DataFrame, list[str]]:
    """docs with the statistics of `text` as columns, and their names; further columns stand in the same projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.withColumns({
        "_w": F.filter(F.split(text, SPACE), lambda w: w != ""),
        "_l": F.split(text, "\n"),
        "_n": F.length(text),
    })
    words, lines, n = F.col("_w"), F.col("_l"), F.col("_n")
    count = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(count - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(count - 1, F.lit(0))), lambda a, b: a == b)
    stats = {
        "upper": _share(_lost(text, r"\p{Lu}+"), n),
        "symbols": _share(_lost(text, r"[^\p{L}\p{N}\s]+"), n),
        "digits": _share(_lost(text, r"\p{N}+"), n),
        "symbol_runs": _share(_lost(text, r"[^\p{L}\p{N}\s]{2,}"), n),
        "lone_symbols": _share(F.size(F.filter(words, lambda w: (F.length(w) == 1) & w.rlike(r"[^\p{L}\p{N}]"))), count),
        "stops": _share(_lost(text, r"[.,](?=\s|$)"), count),
        "distinct_words": _share(F.size(F.array_distinct(words)), count),
        "repeats": _share(F.size(F.filter(pairs, lambda x: x)), count),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": _share(count, F.size(lines)),
        "word_length": _share(n, count),
        "short_words": _share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), count),
        "log_words": F.log1p(count.cast("double")),
    }
    named = {f"_s_{k}": v for k, v in stats.items()}
    return first.withColumns(named | more).drop("_w", "_l", "_n"), list(named)


class RuleEnsemble:
    """score = logistic(intercept + sum of the weights of the rules that hold)."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 7) -> RuleEnsemble:
        share = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls([], np.zeros(0), float(np.log(share / (1 - share))))
        rules = tree_rules(x, y, trees, depth, seed)
        held = np.random.default_rng(seed).random(len(y)) < 0.25
        design = rule_matrix(rules, x)
        best, path = None, []
        start = (np.zeros(len(rules)), 0.0)
        penalties = np.geomspace(0.03, 0.0003, 8)
        for penalty in penalties:
            start = lasso_logistic(design[~held], y[~held], penalty, start)
            loss = log_loss(design[held] @ start[0] + start[1], y[held])
            path.append(loss)
            best = loss if best is None else min(best, loss)
        # The sparsest ensemble that loses next to nothing against the best.
        chosen = penalties[next(i for i, loss in enumerate(path) if loss <= best * 1.02 + 0.003)]
        weights, intercept = lasso_logistic(design, y, chosen, (np.zeros(len(rules)), 0.0), steps=400)
        keep = np.flatnonzero(np.abs(weights) > 1e-6)
        return cls([rules[i] for i in keep], weights[keep], float(intercept))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rule_matrix(self.rules, x) @ self.weights + self.intercept)))

    def column(self, names: list[str]) -> Column:
        """The score as a column over the statistics of these names."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights.tolist(), strict=True):
            holds = None
            for k, above, most in rule:
                for test in ([F.col(names[k]) > above] if np.isfinite(above) else []) + ([F.col(names[k]) <= most] if np.isfinite(most) else []):
                    holds = test if holds is None else holds & test
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for k, above, most in rule:
            out[:, j] *= (x[:, k] > above) & (x[:, k] <= most)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, bins: int = 48, rate: float = 0.3) -> list[Rule]:
    """The paths to all nodes of gradient-boosted trees, each once."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    score, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        nodes = [(rows, np.arange(len(y)), {})]  # rows that grow it, rows in it, conditions
        for level in range(depth + 1):
            after = []
            for own, inside, path in nodes:
                if path:
                    found.setdefault(tuple((k, a, b) for k, (a, b) in sorted(path.items())))
                split = _split(binned[own], gradient[own], hessian[own], edges) if level < depth and len(own) >= 20 else None
                if split is None:
                    score[inside] += rate * gradient[own].sum() / (hessian[own].sum() + 1.0)
                    continue
                k, b = split
                above, most = path.get(k, (-np.inf, np.inf))
                cut = float(edges[k][b])
                for low, bounds in ((True, (above, min(most, cut))), (False, (max(above, cut), most))):
                    pick = (lambda r, low=low: r[(binned[r, k] <= b) == low])
                    after.append((pick(own), pick(inside), path | {k: bounds}))
            nodes = after
    return list(found)


def _split(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    total_g, total_h = gradient.sum(), hessian.sum()
    best, at = total_g**2 / (total_h + 1.0) + 1e-3, None
    for k, e in enumerate(edges):
        if not len(e):
            continue
        g = np.cumsum(np.bincount(binned[:, k], gradient, len(e) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[:, k], hessian, len(e) + 1))[:-1]
        n = np.cumsum(np.bincount(binned[:, k], minlength=len(e) + 1))[:-1]
        gain = g**2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0)
        gain[(n < 5) | (len(binned) - n < 5)] = 0
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, at = gain[b], (k, b)
    return at


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def lasso_logistic(design: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    full = np.hstack([design, np.ones((len(design), 1), np.float32)])
    weights = np.append(*start).astype(np.float64)
    vector = np.ones(full.shape[1])
    for _ in range(12):
        vector = full.T @ (full @ vector)
        vector /= np.linalg.norm(vector)
    step = 4 * len(y) / max(float(vector @ (full.T @ (full @ vector))), 1e-9)
    ahead, t = weights.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(full @ ahead.astype(np.float32))))
        moved = ahead - step * (full.T @ (p - y).astype(np.float32)) / len(y)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = moved + (t - 1) / after * (moved - weights), moved, after
    return weights[:-1], float(weights[-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> RuleEnsemble:
    """Fit on documents whose labels are not held out, max_sample of them at most."""
    # At most max_sample rows of 12 bytes: small enough to broadcast at any size of the corpus.
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    stats, names = with_statistics(rows)
    # A doc_id may stand on many rows, so the joined sample is bounded once more.
    got = stats.select("doc_id", "_y", *names).orderBy(F.xxhash64("doc_id"), "doc_id", "_y", *names).limit(max_sample).toPandas()
    return RuleEnsemble.fit(got[names].to_numpy(np.float64), got["_y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, name: str = "score") -> DataFrame:
    """docs with the score of each text."""
    stats, names = with_statistics(docs)
    return stats.withColumn(name, model.column(names)).drop(*names)


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float) -> DataFrame:
    """The rows of docs whose score is at least the threshold.

    The planner moves a filter below a projection and writes its expressions out there, so each rule would work its statistics out from
    the text again. It does not move one below a number of its own for each row, so that stands beside the statistics.
    """
    stats, names = with_statistics(docs, _at=F.monotonically_increasing_id())
    return stats.where((model.column(names) >= threshold) & (F.col("_at") >= 0)).drop(*names, "_at")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
