"""Re-scoring of tree ensembles after one feature of a row has changed.

An index leads from each feature to the trees that test it. When a value is replaced, only those trees
are walked again, and of their rows only those whose path met a test of the feature; all other leaves stay.
So what a feature contributes to a row, or what a swapped value does to its score, is found on the row
itself: rows are neither multiplied by the number of features nor joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import scratch_folder


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; a leaf has feature -1. ``left`` holds the categories that go left, or None for a threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    categories: list
    child: np.ndarray
    value: np.ndarray

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf value of each row, whether its path tests each feature)."""
        at, met = np.zeros(len(x), np.int64), np.zeros(x.shape, bool)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            tested = self.feature[node]
            met[going, tested] = True
            own = x[going, tested]
            right = own > self.threshold[node]
            for n in np.unique(node):
                if self.categories[n] is not None:
                    here = node == n
                    right[here] = ~np.isin(own[here], self.categories[n])
            at[going] = self.child[node, right.astype(np.int64)]
            going = going[self.feature[at[going]] >= 0]
        return self.value[at], met


def read_trees(spark: SparkSession, model) -> list[Tree]:
    """The trees of a fitted ensemble, through its stored form; the model is small enough for the driver by nature."""
    path = scratch_folder(spark, "trees")
    model.write().save(path)
    forest = isinstance(model, RandomForestClassificationModel)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r)
    out = []
    for _, nodes in sorted(trees.items()):
        place = {r["id"]: i for i, r in enumerate(nodes)}
        inner = [r["leftChild"] >= 0 for r in nodes]
        by_set = [ok and r["split"]["numCategories"] >= 0 for ok, r in zip(inner, nodes)]
        out.append(Tree(
            np.array([r["split"]["featureIndex"] if ok else -1 for ok, r in zip(inner, nodes)], np.int64),
            np.array([r["split"]["leftCategoriesOrThreshold"][0] if ok and not s else 0.0 for ok, s, r in zip(inner, by_set, nodes)]),
            [np.array(r["split"]["leftCategoriesOrThreshold"]) if s else None for s, r in zip(by_set, nodes)],
            np.array([(place[r["leftChild"]], place[r["rightChild"]]) if ok else (0, 0) for ok, r in zip(inner, nodes)], np.int64),
            np.array([r["impurityStats"][1] / sum(r["impurityStats"]) if forest else r["prediction"] for r in nodes]),
        ))
    return out


@dataclass(frozen=True)
class TreeIndex:
    """An ensemble that can be scored again for one group of slots at a time."""

    trees: list
    weights: np.ndarray
    boosted: bool
    groups: tuple

    @classmethod
    def of(cls, spark: SparkSession, model, groups: Sequence[Sequence[int]]) -> TreeIndex:
        boosted = isinstance(model, GBTClassificationModel)
        trees = read_trees(spark, model)
        weights = np.array(model.treeWeights) if boosted else np.full(len(trees), 1 / len(trees))
        return cls(trees, weights, boosted, tuple(tuple(g) for g in groups))

    def tested(self) -> list[bool]:
        """Whether any tree tests a slot of each group."""
        used = {int(i) for tree in self.trees for i in tree.feature if i >= 0}
        return [not used.isdisjoint(slots) for slots in self.groups]

    def rescored(self, name: str, other: Column | None = None, neutral: Sequence[float] | None = None) -> Column:
        """Array of the scores of a row, one per group, with the values of the group taken from ``other`` or ``neutral``."""
        trees, weights, boosted, groups = self.trees, self.weights, self.boosted, self.groups
        fixed = None if neutral is None else np.array(neutral, np.float64)

        def probability(total: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-2 * total)) if boosted else total

        tests = [[] for _ in groups]
        for t, tree in enumerate(trees):
            used = set(tree.feature[tree.feature >= 0].tolist())
            for g, slots in enumerate(groups):
                if used & set(slots):
                    tests[g].append(t)

        def again(rows: pd.Series, given: np.ndarray) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            leaves, met = np.empty((len(x), len(trees))), []
            for t, tree in enumerate(trees):
                leaves[:, t], path = tree.walk(x)
                met.append(path)
            leaves *= weights
            # sums are taken over all trees in one order, so that rows with the same leaves keep the same score
            out = np.repeat(leaves.sum(1)[:, None], len(groups), 1)
            changed = x.copy()
            for g, slots in enumerate(groups):
                if not tests[g]:
                    continue
                slots = list(slots)
                changed[:, slots] = given[:, slots]
                own, touched = leaves.copy(), np.zeros(len(x), bool)
                for t in tests[g]:
                    rows_met = np.flatnonzero(met[t][:, slots].any(1))
                    if len(rows_met):
                        own[rows_met, t] = weights[t] * trees[t].walk(changed[rows_met])[0]
                        touched[rows_met] = True
                out[touched, g] = own[touched].sum(1)
                changed[:, slots] = x[:, slots]
            return pd.Series(list(probability(out)))

        if fixed is None:
            def swapped(rows: pd.Series, others: pd.Series) -> pd.Series:
                return again(rows, np.stack(others.to_numpy()) if len(others) else np.zeros((0, 0)))

            return _udf(swapped)(vector_to_array(name), other)

        def replaced(rows: pd.Series) -> pd.Series:
            return again(rows, np.broadcast_to(fixed, (len(rows), len(fixed))))

        return _udf(replaced)(vector_to_array(name))


def _udf(function):
    kinds = {"rows": pd.Series, "others": pd.Series, "return": pd.Series}
    function.__annotations__ = {k: v for k, v in kinds.items() if k in (*function.__code__.co_varnames[: function.__code__.co_argcount], "return")}
    return F.pandas_udf(function, "array<double>")


def is_tree_model(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], (GBTClassificationModel, RandomForestClassificationModel))


def encoded(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the vector that the classifier of a pipeline reads."""
    out = df
    for stage in model.stages[:-1]:
        out = stage.transform(out)
    return out.select(*df.columns, "features")
