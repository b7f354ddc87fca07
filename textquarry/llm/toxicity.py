"""Toxicity by a classifier chain.

Categories are predicted one after another. Each is a logistic regression on
the text's features and on the probabilities of all earlier categories; in
training those are out-of-fold predictions, so a later link learns from
probabilities as good as it will meet. The table of labels grades two
categories, poor quality and toxicity, in this order: the last link is
toxicity itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE, SELECTED, dense, fit_logistic, labelled_sample, score_rows, select_features, sigmoid

CATEGORIES = ("low_quality", "toxic")  # in the order of the chain
FOLDS = 5
CUT = 0.3


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(x: np.ndarray, targets: list[np.ndarray], folds: int = FOLDS) -> list[np.ndarray]:
    """Per link its weights: features, logits of earlier links, intercept."""
    fold = np.arange(len(x)) % folds
    links, earlier = [], np.empty((len(x), 0), np.float32)
    for y in targets:
        own = np.concatenate([x, earlier], axis=1)
        links.append(fit_logistic(own, y))
        out = np.zeros(len(x))
        for k in range(folds):
            w = fit_logistic(own[fold != k], y[fold != k])
            out[fold == k] = sigmoid(own[fold == k] @ w[:-1] + w[-1])
        earlier = np.concatenate([earlier, logit(out)[:, None].astype(np.float32)], axis=1)
    return links


def chain_finish(names: list[str], tails: list[np.ndarray], cut: float):
    """From sums of feature weights to the probabilities of the chain; tails: weights of earlier links, and the intercept."""

    def finish(sums: np.ndarray) -> dict[str, np.ndarray]:
        out, earlier = {}, np.empty((len(sums), 0))
        for k, (name, tail) in enumerate(zip(names, tails, strict=True)):
            p = sigmoid(sums[:, k] + earlier @ tail[:-1] + tail[-1])
            out[f"p_{name}"] = p
            earlier = np.concatenate([earlier, logit(p)[:, None]], axis=1)
        return out | {"toxic": out[f"p_{names[-1]}"] >= cut}

    return finish


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, selected: int = SELECTED, cut: float = CUT) -> DataFrame:
    """`docs` with p_low_quality, p_toxic and toxic (p_toxic >= cut).

    Fitted on at most `bound` labelled rows, one per doc_id, and at most
    `selected` features for each category; null labels count as 0. Null text is
    scored by its shape alone, null ids and repeated rows are scored row by row.
    Without labels nothing is toxic. An empty table gives an empty result;
    columns of `docs` named like results are replaced.
    """
    names = list(CATEGORIES)
    docs = docs.drop(*[f"p_{n}" for n in names], "toxic")
    targets = {"low_quality": F.col("quality") <= 0, "toxic": F.col("toxic") > 0}
    sample = labelled_sample(docs, labels.select("doc_id", "quality", "toxic"), targets, bound)
    chosen = np.unique(np.concatenate([select_features(sample, F.col(n) > 0, selected) for n in names]))
    x, y = dense(sample, chosen, names)
    links = fit_chain(x, [y[n] for n in names])
    weights = np.stack([w[: len(chosen)] for w in links], axis=1)
    tails = [w[len(chosen) :] for w in links]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    run = score_rows(chosen, weights, chain_finish(names, tails, cut if len(x) else 2.0))
    return docs.mapInArrow(run, f"{fields}, {', '.join(f'p_{n} double' for n in names)}, toxic boolean")
