"""Path attribution for boosted trees: what each split on a row's way to its leaves adds to the margin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_tables(model) -> list[dict]:
    """A fitted MLlib tree ensemble as arrays by node; ``feature`` is -1 at leaves. Their size is that of the model."""

    def walk(node, t: dict) -> int:
        at = len(t["value"])
        t["value"].append(node.prediction())
        for c in ("feature", "threshold", "left", "right"):
            t[c].append(-1)
        if node.subtreeDepth() > 0:
            t["feature"][at], t["threshold"][at] = node.split().featureIndex(), node.split().threshold()
            t["left"][at] = walk(node.leftChild(), t)
            t["right"][at] = walk(node.rightChild(), t)
        return at

    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        t = {c: [] for c in ("feature", "threshold", "left", "right", "value")}
        walk(tree._call_java("rootNode"), t)
        out.append({"weight": weight} | {c: np.array(v, float if c in ("threshold", "value") else int) for c, v in t.items()})
    return out


def attribute(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Rows by features: the sum, over splits on the feature, of the change in the node's mean. A row's sum and
    the weighted means of the roots make its margin."""
    out = np.zeros(x.shape)
    for t in trees:
        at = np.zeros(len(x), int)
        while len(rows := np.flatnonzero(t["feature"][at] >= 0)):
            here = at[rows]
            f = t["feature"][here]
            at[rows] = np.where(x[rows, f] <= t["threshold"][here], t["left"][here], t["right"][here])
            out[rows, f] += t["weight"] * (t["value"][at[rows]] - t["value"][here])
    return out


def path_contributions(model, columns: list[str | Column]) -> Column:
    """Array of doubles, one for each of the columns, which hold no null."""
    trees = tree_tables(model)

    @F.pandas_udf("array<double>")
    def paths(x: pd.Series) -> pd.Series:
        return pd.Series(list(attribute(np.array(x.tolist(), float).reshape(len(x), -1), trees)))

    return paths(F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]))


def explained(contributions: Column, columns: list[str], k: int = 5) -> Column:
    """JSON list of [feature, contribution], the k largest above 0, largest first."""
    named = F.zip_with(F.array(*map(F.lit, columns)), contributions, lambda n, c: F.struct((-c).alias("o"), n.alias("feature")))
    best = F.slice(F.filter(F.array_sort(named), lambda s: s["o"] < 0), 1, k)
    return F.to_json(F.transform(best, lambda s: F.struct(s["feature"].alias("feature"), (-s["o"]).alias("contribution"))))
