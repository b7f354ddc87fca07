"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights on hashed text is shared by all grades; ordered
thresholds cut its score, P(grade > k) = sigmoid(score - threshold k). Their
sum is the expected grade; the tail probability of the least grade asked for
selects documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE, SELECTED, dense, descend, labelled_sample, score_rows, select_features, sigmoid

GRADES = 3  # 0: poor; 1: good but toxic; 2: good
SELECT_FROM, CUT = 1, 0.5


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds that maximise the likelihood of the grades, less the penalty on weights.

    With s the score and t the thresholds, P(grade = k) = F(t[k] - s) -
    F(t[k - 1] - s), F logistic. Thresholds are a first one and the logs of
    positive steps, so they stay in order.
    """
    n, k = max(1, len(grade)), grades - 1
    x = x.astype(np.float32)
    xt = np.ascontiguousarray(x.T)
    grade = grade.astype(np.int64)

    def thresholds(t: np.ndarray) -> np.ndarray:
        return t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])

    def gradient(w: np.ndarray) -> np.ndarray:
        t = np.concatenate([[-np.inf], thresholds(w[-k:]), [np.inf]])
        s = x @ w[:-k].astype(np.float32)
        upper, lower = sigmoid(t[grade + 1] - s), sigmoid(t[grade] - s)
        mass = np.maximum(upper - lower, 1e-12)
        by_score = (1 - upper - lower).astype(np.float32)  # of -log P: (f(upper) - f(lower)) / mass
        by_threshold = np.zeros(grades + 1)
        np.add.at(by_threshold, grade + 1, -upper * (1 - upper) / mass / n)
        np.add.at(by_threshold, grade, lower * (1 - lower) / mass / n)
        inner = by_threshold[1:-1]
        steps = np.exp(w[len(w) - k + 1 :]) * inner[::-1].cumsum()[::-1][1:]
        return np.concatenate([xt @ by_score / n + penalty * w[:-k] / n, [inner.sum()], steps])

    start = np.zeros(x.shape[1] + k)
    start[-k] = -1.0
    w = descend(gradient, start)
    return w[:-k], thresholds(w[-k:])


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, selected: int = SELECTED, select_from: int = SELECT_FROM, cut: float = CUT) -> DataFrame:
    """`docs` with expected_grade, p_at_least_1 ... and kept (probability of grade >= `select_from` is at least `cut`).

    The table of labels has two marks of 0 or 1, so the graded rating is made of
    both: 0 if quality is 0, else 1 if toxic, else 2; null labels count as 0.
    Fitted on at most `bound` labelled rows, one per doc_id. Null text is scored
    by its shape, null ids and repeated rows row by row. Without labels
    thresholds keep their start and all rows are kept. An empty table gives an
    empty result; columns named like results are replaced.
    """
    names = ["expected_grade", *[f"p_at_least_{k}" for k in range(1, GRADES)], "kept"]
    docs = docs.drop(*names)
    grade = F.when(F.coalesce("quality", F.lit(0)) <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    sample = labelled_sample(docs, labels.select("doc_id", "quality", "toxic"), {"grade": grade}, bound)
    half = selected // 2  # features that tell each threshold's two sides apart
    chosen = np.unique(np.concatenate([select_features(sample, F.col("grade") > k, half) for k in range(GRADES - 1)]))
    x, y = dense(sample, chosen, ["grade"])
    weights, thresholds = fit_ordinal(x, y["grade"], GRADES)

    def finish(sums: np.ndarray) -> dict[str, np.ndarray]:
        tail = sigmoid(sums[:, :1] - thresholds[None, :])
        return {"expected_grade": tail.sum(axis=1), **{f"p_at_least_{k + 1}": tail[:, k] for k in range(GRADES - 1)}, "kept": tail[:, select_from - 1] >= cut}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    types = ", ".join(f"{n} double" for n in names[:-1])
    return docs.mapInArrow(score_rows(chosen, weights[:, None], finish), f"{fields}, {types}, kept boolean")
