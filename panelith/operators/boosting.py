"""Gradient-boosted trees over binned features, grown best leaf first.

A model is fitted in one task from a bounded number of cells, so that one pass over the data per model suffices
and many models can be fitted side by side; predictions run over all rows with the model's few hundred kilobytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``most_cells`` bounds what one model is fitted on, in rows times features; of more rows those of least hash are taken."""

    rounds: int = 300
    leaves: int = 31
    rate: float = 0.05
    rows_per_leaf: int = 20
    feature_share: float = 0.7
    row_share: float = 0.7
    l2: float = 10.0
    bins: int = 255
    seed: int = 7
    binary: bool = False
    most_cells: int = 100_000_000


@dataclass
class Tree:
    """Nodes in the order they were made: feature (-1 in a leaf), greatest value that goes left, children, value and gain."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            column.append(x)
        return len(self.value) - 1

    def apply(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])
            inner = inner[feature[at[inner]] >= 0]
        return np.array(self.value)[at]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    binary: bool
    n_features: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.apply(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The label's mean, or the chance of label 1."""
        raw = self.raw(x)
        return 1 / (1 + np.exp(-raw)) if self.binary else raw

    def importance(self) -> np.ndarray:
        """Each feature's share of all gains."""
        gains = np.zeros(self.n_features)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    gains[f] += g
        return gains / (gains.sum() or 1.0)


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Values between bins: all distinct ones, or quantiles of very many."""
    distinct = np.unique(x)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(distinct, np.linspace(0, 1, bins), method="lower"))
    return distinct[:-1]


class Grower:
    """One tree from gradients: the open leaf of the greatest gain is split next; the larger child's sums are the parent's less the smaller's."""

    def __init__(self, codes: np.ndarray, cuts: list[np.ndarray], settings: Settings):
        self.codes, self.cuts, self.s = codes, cuts, settings
        self.width = settings.bins + 1
        self.offsets = np.arange(codes.shape[1], dtype=np.int64) * self.width

    def sums(self, rows: np.ndarray, used: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        cells = (self.codes[np.ix_(rows, used)] + self.offsets[: len(used)]).reshape(-1)
        size = len(used) * self.width
        return np.stack([np.bincount(cells, np.repeat(v, len(used)), size) for v in (grad[rows], hess[rows])] + [np.bincount(cells, minlength=size)]).reshape(3, len(used), self.width)

    def best(self, held: np.ndarray) -> tuple[float, int, int]:
        """Gain, place of the feature and bin of the best split."""
        upto = held.cumsum(axis=2)
        whole = upto[:, :, -1:]
        rest = whole - upto
        score = lambda v: v[0] ** 2 / (v[1] + self.s.l2)
        gain = score(upto) + score(rest) - score(whole)
        gain[(upto[2] < self.s.rows_per_leaf) | (rest[2] < self.s.rows_per_leaf)] = -np.inf
        at = int(gain.argmax())
        return float(gain.reshape(-1)[at]), at // self.width, at % self.width

    def grow(self, rows: np.ndarray, used: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> Tree:
        tree = Tree()
        value = lambda r: -self.s.rate * float(grad[r].sum()) / (float(hess[r].sum()) + self.s.l2)
        first = self.sums(rows, used, grad, hess)
        leaves = [(self.best(first), tree.leaf(value(rows)), rows, first)]
        while len(leaves) < self.s.leaves:
            i = max(range(len(leaves)), key=lambda k: leaves[k][0][0])
            (gain, place, bin_), node, own, held = leaves[i]
            if not gain > 1e-12:
                break
            feature = int(used[place])
            goes = self.codes[own, feature] <= bin_
            small, large = (own[goes], own[~goes]) if goes.sum() * 2 <= len(own) else (own[~goes], own[goes])
            less = self.sums(small, used, grad, hess)
            by = {id(small): less, id(large): held - less}
            left, right = (small, large) if goes.sum() * 2 <= len(own) else (large, small)
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, float(self.cuts[feature][bin_]), gain
            leaves.pop(i)
            for side, part in (("left", left), ("right", right)):
                getattr(tree, side)[node] = child = tree.leaf(value(part))
                leaves.append((self.best(by[id(part)]), child, part, by[id(part)]))
        return tree


def fitted(x: np.ndarray, y: np.ndarray, settings: Settings) -> Boosted:
    """Squared loss, or log loss for labels 0 and 1. Without rows the model predicts 0, or one half."""
    n, f = x.shape
    if not n:
        return Boosted(0.0, [], settings.binary, f)
    cuts = [cuts_of(x[:, j], settings.bins) for j in range(f)]
    codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.int64)
    mean = float(y.mean())
    held = min(max(mean, 1e-6), 1 - 1e-6)
    model = Boosted(float(np.log(held / (1 - held))) if settings.binary else mean, [], settings.binary, f)
    now, r = np.full(n, model.base), np.random.default_rng(settings.seed)
    grower = Grower(codes, cuts, settings)
    for _ in range(settings.rounds):
        if settings.binary:
            p = 1 / (1 + np.exp(-now))
            grad, hess = p - y, p * (1 - p)
        else:
            grad, hess = now - y, np.ones(n)
        rows = np.sort(r.permutation(n)[: max(1, round(settings.row_share * n))])
        used = np.sort(r.permutation(f)[: max(1, round(settings.feature_share * f))])
        tree = grower.grow(rows, used, grad, hess)
        model.trees.append(tree)
        now += tree.apply(x)
    return model


def features_of(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Unknown values as 0."""
    return np.nan_to_num(pdf[names].to_numpy(np.float32), nan=0.0)


def sampled(rows: DataFrame, names: list[str], settings: Settings) -> DataFrame:
    """All rows, or about as many of least hash as the bound on cells allows."""
    most = max(1, settings.most_cells // max(1, len(names)))
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(rows: DataFrame, names: list[str], label: str, settings: Settings) -> Boosted:
    """A model of ``label`` by ``names``; rows without a label are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(features_of(b, names), b[label].to_numpy(np.float64)) for b in batches]
        x = np.concatenate([h[0] for h in held]) if held else np.empty((0, len(names)), np.float32)
        y = np.concatenate([h[1] for h in held]) if held else np.empty(0)
        # The order of rows, which the samples of each round depend on, must not be that of their arrival.
        order = np.lexsort((y, *x.T))
        yield pd.DataFrame({"model": [pickle.dumps(fitted(x[order], y[order], settings))]})

    known = sampled(rows.where(F.col(label).isNotNull()).select(*[F.col(n).cast("float").alias(n) for n in names], F.col(label).cast("double").alias(label)), names, settings)
    return pickle.loads(known.coalesce(1).mapInPandas(run, "model binary").first()["model"])


def predicted(rows: DataFrame, model: Boosted, names: list[str], out: str) -> DataFrame:
    """``rows`` with the model's prediction for each."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(np.float32) for c in columns]), nan=0.0)
        return pd.Series(shared.value.predict(x))

    return rows.withColumn(out, predict(*[F.col(n).cast("float") for n in names]))


def settings_of(trees: dict | None, **fixed: object) -> Settings:
    return replace(Settings(**fixed), **(trees or {}))


