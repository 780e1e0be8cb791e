"""Isolation forest: trees grown on small hashed samples, scoring spread over all rows.

The sample is trees x sample_size rows whatever the table size. Each tree is grown in its own task; the
finished forest has at most trees x 2 x sample_size nodes, which bounds what is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    out = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, int, float, int, int, int]]:
    """Split random features at random places until points are alone or the depth limit is reached."""
    nodes: list[list] = []
    open_nodes = [(points, 0, None)]
    while open_nodes:
        part, depth, parent = open_nodes.pop()
        number = len(nodes)
        nodes.append([number, -1, 0.0, -1, -1, len(part)])
        if parent is not None:
            nodes[parent[0]][parent[1]] = number
        low, high = part.min(axis=0), part.max(axis=0)
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(spread):
            continue
        feature = int(rng.choice(spread))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] < threshold
        nodes[number][1:3] = [feature, threshold]
        open_nodes.append((part[~goes_left], depth + 1, (number, 4)))
        open_nodes.append((part[goes_left], depth + 1, (number, 3)))
    return [tuple(n) for n in nodes]


def sample_for_trees(df: DataFrame, id_column: str, trees: int, sample_size: int, seed: int) -> DataFrame:
    """Rows with the tree they help to grow, about `sample_size` per tree.

    One rule at every size: a hash of the row gives the number of its draws (Poisson with mean trees x sample_size / rows),
    and each draw picks a tree by another hash. A row helps the same tree once.
    """
    mean = trees * sample_size / max(df.count(), 1)
    term = total = math.exp(-min(mean, 600.0))
    steps = []  # the share of rows with at most 0, 1, 2, ... draws
    while total < 1 - 1e-9 and len(steps) < 10 * trees:
        steps.append(total)
        term *= mean / len(steps)
        total += term
    whole = 2**31
    u = F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(whole)) / F.lit(whole)
    draws = F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: x <= F.col("_u")))
    pick = F.transform(
        F.sequence(F.lit(1), F.col("_draws")), lambda k: F.pmod(F.xxhash64(F.lit(seed + 1), id_column, k), F.lit(trees)).cast("int"))
    drawn = df.withColumn("_u", u).withColumn("_draws", draws).filter("_draws > 0")
    return drawn.withColumn("tree", F.explode(F.array_distinct(pick))).drop("_u", "_draws")


def fit(df: DataFrame, id_column: str, features: str, trees: int = 100, sample_size: int = 256, seed: int = 42) -> DataFrame:
    """The node table of a forest over an array column of features."""
    limit = math.ceil(math.log2(sample_size))
    sample = sample_for_trees(df.select(id_column, features), id_column, trees, sample_size, seed)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_column)
        tree = int(part["tree"].iloc[0])
        points = np.stack(part[features].to_numpy()).astype(float)
        nodes = grow(points, limit, np.random.default_rng([seed, tree]))
        columns = ["node", "feature", "threshold", "left", "right", "size"]
        out = pd.DataFrame(nodes, columns=columns)
        out.insert(0, "tree", tree)
        return out

    return sample.groupBy("tree").applyInPandas(one, NODE_SCHEMA)


def score(df: DataFrame, features: str, nodes: DataFrame, sample_size: int = 256, into: str = "anomaly_score") -> DataFrame:
    """Add 2^(-mean path / expected path); the forest is small by construction and goes to every task."""
    table = nodes.orderBy("tree", "node").toPandas()
    forest = [
        tuple(part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size")) for _, part in table.groupby("tree")
    ]
    held = df.sparkSession.sparkContext.broadcast(forest)
    expected = float(mean_path(sample_size))

    @F.pandas_udf("double")
    def path_score(batch: pd.Series) -> pd.Series:
        points = np.stack(batch.to_numpy()).astype(float)
        total = np.zeros(len(points))
        for feature, threshold, left, right, size in held.value:
            at, depth = np.zeros(len(points), dtype=int), np.zeros(len(points))
            inner = feature[at] >= 0
            while inner.any():
                rows = np.flatnonzero(inner)
                here = at[rows]
                lower = points[rows, feature[here]] < threshold[here]
                at[rows] = np.where(lower, left[here], right[here])
                depth[rows] += 1
                inner = feature[at] >= 0
            total += depth + mean_path(size[at])
        return pd.Series(2.0 ** (-total / len(held.value) / expected))

    return df.withColumn(into, path_score(F.col(features)))


def cutoff(df: DataFrame, score_column: str, contamination: float) -> Column:
    """The score above which the given share of rows lies, by a mergeable sketch."""
    return df.agg(F.percentile_approx(score_column, 1.0 - contamination, 100_000)).scalar()
