"""Isolation forest (I1-I5) on Spark.

Fit (I1)
    Each training row joins tree ``t`` a Poisson(psi / N) number of times,
    independently per tree: the Poisson bootstrap that Spark ML uses for
    bagging. It is drawn JVM-side from hashes of ``task_id`` (repeatable
    under any partitioning or retry): the total count K ~ Poisson(T psi / N)
    comes from an inverse-CDF lookup, then each of the K copies picks a tree
    by another hash. Rows with K = 0, almost all of them at scale, are
    dropped in the scan stage. Each tree then gets about psi rows, grouped by
    ``tree`` and built in ``applyInPandas`` (Liu, Ting and Zhou 2008):
    random feature (from a per-tree subset of ``max_features``), uniform
    split value, depth limit ceil(log2 psi).
    The forest has at most T (2 psi - 1) nodes, a bound fixed by the
    parameters, so it is collected and broadcast.

Score (I2)
    A vectorised pandas UDF walks the trees level by level, a block of rows
    and trees at a time: s(x) = 2 ** (-E[h(x)] / c(psi)), higher = more anomalous.

Threshold and flag (I3, I4)
    The (1 - contamination) quantile of the positive training score.

Attribution (I5)
    Not SHAP. Every node stores v(n), the mean path length of the training
    rows that reach it. A row's path credits the split feature of each node
    with v(child) - v(node); the credits sum to h(x) - v(root), averaged over
    trees. Negative = the feature isolates the row early.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from taskwatch.config import Params
from taskwatch.session import broadcast_model, ship_package

EULER = 0.5772156649


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def poisson_cdf(mu: float, tail: float = 1e-15) -> list[float]:
    """CDF values P(K <= k) for k = 0, 1, ... until the tail is negligible."""
    out, p, acc, k = [], math.exp(-mu), 0.0, 0
    while True:
        acc += p
        out.append(min(acc, 1.0))
        k += 1
        if acc >= 1.0 - tail or k > mu + 40 * math.sqrt(mu) + 40:
            break
        p *= mu / k
    return out


def unit_hash(*cols: Column) -> Column:
    """A uniform double in [0, 1) from a 64-bit hash of the columns."""
    h = F.xxhash64(*cols)
    return (F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53)))


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])


def bootstrap_sample(X: DataFrame, features: list[str], n_rows: int, params: Params,
                     id_col: str = "task_id") -> DataFrame:
    """(tree, features...) rows: the Poisson bootstrap of every tree."""
    psi = min(params.max_samples, n_rows)
    mu = params.n_trees * psi / max(n_rows, 1)
    cdf = poisson_cdf(mu)
    seed = F.lit(params.seed)
    u = unit_hash(F.col(id_col), seed)
    k = F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c < u))
    keep = X.where(u >= F.lit(cdf[0])).withColumn("__k", k)
    copies = keep.withColumn("__j", F.explode(F.sequence(F.lit(1), F.col("__k"))))
    tree = F.pmod(F.xxhash64(F.col(id_col), seed, F.col("__j")), F.lit(params.n_trees)).cast("int")
    return copies.select(tree.alias("tree"), *[F.col(f).cast("double") for f in features])


def _build_tree(tree_id: int, X: np.ndarray, params: Params, psi: int) -> list[tuple]:
    rng = np.random.default_rng([params.seed, int(tree_id)])
    n, d = X.shape
    n_feat = max(1, int(round(params.max_features * d))) if isinstance(params.max_features, float) \
        else int(params.max_features)
    subset = rng.choice(d, size=min(n_feat, d), replace=False)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    feature, threshold, left, right, size, depth, members = [], [], [], [], [], [], []

    def new_node(idx, dep):
        feature.append(-1); threshold.append(0.0); left.append(-1); right.append(-1)
        size.append(len(idx)); depth.append(dep); members.append(idx)
        return len(feature) - 1

    stack = [new_node(np.arange(n), 0)]
    while stack:
        node = stack.pop()
        idx, dep = members[node], depth[node]
        if dep >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        for f in rng.permutation(subset):
            col = sub[:, f]
            lo, hi = col.min(), col.max()
            if hi > lo:
                thr = lo + rng.random() * (hi - lo)
                if thr >= hi:
                    thr = lo
                go_left = col <= thr
                feature[node] = int(f)
                threshold[node] = float(thr)
                left[node] = new_node(idx[go_left], dep + 1)
                right[node] = new_node(idx[~go_left], dep + 1)
                stack.extend([left[node], right[node]])
                break
    # path length of every training row, then v(node) = mean over rows reaching it
    h = np.zeros(n)
    for node in range(len(feature)):
        if feature[node] < 0:
            h[members[node]] = depth[node] + c_factor([size[node]])[0]
    value = [float(h[m].mean()) if len(m) else 0.0 for m in members]
    return [(int(tree_id), i, feature[i], threshold[i], left[i], right[i], size[i], depth[i], value[i])
            for i in range(len(feature))]


@dataclass
class ForestModel:
    features: list[str]
    psi: int
    feature_idx: np.ndarray   # [T, M]
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_h: np.ndarray        # depth + c(size) at leaves
    value: np.ndarray
    max_depth: int
    threshold_score: float | None = None

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, features: list[str], psi: int) -> "ForestModel":
        trees = int(nodes["tree"].max()) + 1 if len(nodes) else 0
        m = int(nodes["node"].max()) + 1 if len(nodes) else 1
        fi = np.full((trees, m), -1, dtype=np.int32)
        th = np.zeros((trees, m)); le = np.zeros((trees, m), dtype=np.int32)
        ri = np.zeros((trees, m), dtype=np.int32); lh = np.zeros((trees, m)); va = np.zeros((trees, m))
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        fi[t, n] = nodes["feature"].to_numpy()
        th[t, n] = nodes["threshold"].to_numpy()
        le[t, n] = nodes["left"].to_numpy()
        ri[t, n] = nodes["right"].to_numpy()
        lh[t, n] = nodes["depth"].to_numpy() + c_factor(nodes["size"].to_numpy())
        va[t, n] = nodes["value"].to_numpy()
        return cls(features, psi, fi, th, le, ri, lh, va, int(nodes["depth"].max()) if len(nodes) else 0)

    def to_nodes(self) -> pd.DataFrame:
        rows = []
        for t in range(self.feature_idx.shape[0]):
            for n in range(self.feature_idx.shape[1]):
                rows.append((t, n, int(self.feature_idx[t, n]), float(self.threshold[t, n]),
                             int(self.left[t, n]), int(self.right[t, n]), float(self.leaf_h[t, n]),
                             float(self.value[t, n])))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                           "leaf_h", "value"])

    # ---- vectorised scoring
    def _tables(self):
        """Flat node tables of the walk: split feature, rank of the threshold
        among those of its feature, the two children (right, left), and the
        thresholds of each feature. A leaf is its own child."""
        if "_flat" not in self.__dict__:
            T, M = self.feature_idx.shape
            leaf, base = self.feature_idx < 0, (np.arange(T) * M)[:, None]
            own = base + np.arange(M)[None, :]
            cuts = [np.unique(self.threshold[self.feature_idx == j]) for j in range(len(self.features))]
            dtype = np.int16 if max(map(len, cuts), default=0) < np.iinfo(np.int16).max else np.int32
            rank = np.zeros((T, M), dtype=dtype)
            for j, c in enumerate(cuts):
                at = self.feature_idx == j
                rank[at] = np.searchsorted(c, self.threshold[at])
            child = np.stack([np.where(leaf, own, base + self.right), np.where(leaf, own, base + self.left)], axis=2)
            self._flat = (np.where(leaf, 0, self.feature_idx).astype(np.int32).ravel(), rank.ravel(),
                          child.astype(np.int32).ravel(), cuts)
        return self._flat

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_flat"}   # made anew where it is used

    def _walk(self, X: np.ndarray, rows: int = 1024, trees: int = 16):
        """All rows down all trees, a block of rows and trees at a time so that
        its tables stay in the processor's cache. Yields per block and level the
        rows as a slice and, as (trees x rows) matrices, the flat node ids before
        and after the level and the split feature; a block's last level has
        ``last``. ``x <= threshold`` holds exactly if at most ``rank`` thresholds
        of the feature are below ``x``, so small ranks are compared."""
        (T, M), d = self.feature_idx.shape, len(self.features)
        feature, rank, child, cuts = self._tables()
        for s in range(0, len(X), rows):
            part = X[s:s + rows]
            below = np.empty((len(part), d), dtype=rank.dtype)
            for j, c in enumerate(cuts):
                below[:, j] = np.searchsorted(c, part[:, j], side="left")
            below, cell = below.ravel(), (np.arange(len(part), dtype=np.int32) * d)[None, :]
            for b in range(0, T, trees):
                node = np.repeat((np.arange(b, min(b + trees, T), dtype=np.int32) * M)[:, None], len(part), axis=1)
                for level in range(self.max_depth):
                    f = feature.take(node)
                    after = child.take(2 * node + (below.take(f + cell) <= rank.take(node)))
                    yield slice(s, s + len(part)), node, after, f, level == self.max_depth - 1
                    node = after

    def path_length(self, X: np.ndarray) -> np.ndarray:
        """Mean path length over all trees."""
        T = self.feature_idx.shape[0]
        out = np.zeros(X.shape[0])
        if T == 0:
            return out
        lh = self.leaf_h.ravel()
        if self.max_depth == 0:
            return out + self.leaf_h[:, 0].mean()
        for at, _, node, _, last in self._walk(X):
            if last:
                out[at] += lh.take(node).sum(axis=0)
        return out / T

    def score(self, X: np.ndarray) -> np.ndarray:
        return np.power(2.0, -self.path_length(X) / c_factor([self.psi])[0])

    def contributions(self, X: np.ndarray) -> np.ndarray:
        """Per row and feature, the change of the expected path length along
        the row's paths, credited to the feature split on; mean over the trees."""
        T, d = self.feature_idx.shape[0], len(self.features)
        out = np.zeros((X.shape[0], d))
        value = self.value.ravel()
        for at, node, after, f, _ in self._walk(X):
            n = at.stop - at.start
            cells = f + np.arange(n, dtype=np.int32)[None, :] * d
            credit = value.take(after) - value.take(node)   # 0 at a leaf, which is its own child
            out[at] += np.bincount(cells.ravel(), weights=credit.ravel(), minlength=n * d).reshape(n, d)
        return out / max(T, 1)


def fit_forest(X: DataFrame, features: list[str], params: Params | None = None,
               n_rows: int | None = None, id_col: str = "task_id") -> ForestModel:
    p = params or Params()
    if n_rows is None:
        n_rows = X.count()
    psi = min(p.max_samples, n_rows)
    ship_package(X.sparkSession)
    sample = bootstrap_sample(X, features, n_rows, p, id_col)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree"].iloc[0])
        mat = pdf[features].to_numpy(dtype=float)
        return pd.DataFrame(_build_tree(tree_id, mat, p, psi), columns=NODE_SCHEMA.fieldNames())

    nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    # bounded by T * (2 psi - 1) rows whatever the data size
    return ForestModel.from_nodes(nodes.toPandas(), features, psi)


def score_column(model: ForestModel, features: list[str]) -> Column:
    """I2 as a pandas UDF over the feature columns."""
    bc = _broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def if_score(*cols: pd.Series) -> pd.Series:
        m = bc.value
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(m.score(X))

    return if_score(*[F.col(f).cast("double") for f in features])


def _broadcast(model):
    return broadcast_model(model)
