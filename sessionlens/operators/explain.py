"""Explanations of fitted models as distributed jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.operators.learning import SEED, assembled, drawn
from sessionlens.session import scratch_path

Scorer = Callable[[DataFrame], DataFrame]  # adds a column `p` to rows with a `features` vector


def permuted(df: DataFrame, id_column: str, columns: Sequence[str], repeats: int, seed: int, block: int = 10_000) -> DataFrame:
    """All rows once per feature and repeat, with that feature's values permuted: adds `feature` and `repeat`.

    Rows fall into blocks by hash and are put in a random order there; the value comes from the row a random distance
    further on in the block's circle. No block outgrows a task, and one join makes all permutations.
    """
    blocks = max(1, df.count() // block)
    order = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), id_column), id_column)
    placed = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(blocks))).withColumns(
        {"_at": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("_b"))})
    runs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for c in columns for r in range(repeats)])
    step = 1 + F.pmod(F.xxhash64(F.lit(seed + 2), "_b", "feature", "repeat"), F.greatest(F.col("_n") - 1, F.lit(1)))
    spread = placed.select("*", F.inline(runs)).withColumn("_from", F.pmod(F.col("_at") + step, F.col("_n")))
    source = placed.select(F.col("_b").alias("_b2"), F.col("_at").alias("_at2"), F.struct(*columns).alias("_other"))
    moved = spread.join(source, (F.col("_b") == F.col("_b2")) & (F.col("_from") == F.col("_at2")))
    changed = {c: F.when(F.col("feature") == c, F.col("_other")[c]).otherwise(F.col(c)) for c in columns}
    return moved.withColumns(changed).drop("_b", "_at", "_n", "_from", "_b2", "_at2", "_other")


def permutation_importance(
    df: DataFrame, id_column: str, columns: Sequence[str], scorer: Scorer, metric: Column, repeats: int = 5
) -> DataFrame:
    """Mean drop of the metric when one feature is permuted: (feature, importance, spread). All runs are scored in one pass."""
    base = scorer(assembled(df, columns)).agg(metric.alias("m")).scalar()
    runs = scorer(assembled(permuted(df, id_column, columns, repeats, SEED), columns)).groupBy("feature", "repeat").agg(metric.alias("_m"))
    drop = base - F.col("_m")
    return runs.withColumn("_d", drop).groupBy("feature").agg(
        F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("spread")
    )


def shapley(
    rows: DataFrame, background: DataFrame, id_column: str, columns: Sequence[str], scorer: Scorer, permutations: int = 16
) -> DataFrame:
    """Sampled Shapley values: (id, feature, value).

    For each row and random feature order, features are switched one by one from a background row's values
    to the row's own; each step's change of the score goes to its feature. All steps are rows of one table
    that the model scores in one pass. Of the background, the `permutations` rows with the lowest hashes are used.
    """
    size = len(columns)
    rng = np.random.default_rng(SEED)
    orders = [rng.permutation(size).tolist() for _ in range(permutations)]
    steps = F.explode(F.sequence(F.lit(0), F.lit(size))).alias("_step")
    table = F.array(*[F.array(*[F.lit(o.index(c)) for c in range(size)]) for o in orders])  # place of each feature
    reference = background.orderBy(F.xxhash64(F.lit(SEED), id_column)).limit(permutations).select(
        F.struct(*[F.col(c).alias(c) for c in columns]).alias("_ref"))
    pool = reference.agg(F.collect_list("_ref")).scalar()
    spread = (
        rows.select(id_column, *columns)
        .withColumn("_pool", pool)
        .withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_ref", F.get("_pool", F.col("_perm") % F.size("_pool")))
        .withColumn("_places", F.get(table, F.col("_perm")))
        .select(id_column, "_perm", "_ref", "_places", *columns, steps)
    )
    mixed = spread.select(
        id_column, "_perm", "_step", "_places",
        *[F.when(F.get("_places", F.lit(i)) < F.col("_step"), F.col(c)).otherwise(F.col("_ref")[c]).alias(c) for i, c in enumerate(columns)],
    )
    scored = scorer(assembled(mixed, columns)).select(id_column, "_perm", "_step", "_places", "p")
    # One walk has as many steps as there are features, so its list is short.
    walks = scored.groupBy(id_column, "_perm").agg(
        F.array_sort(F.collect_list(F.struct("_step", "p"))).alias("_walk"), F.first("_places").alias("_places")
    )
    gains = [
        F.struct(
            F.lit(c).alias("feature"),
            (
                F.get("_walk", F.get("_places", F.lit(i)) + 1)["p"] - F.get("_walk", F.get("_places", F.lit(i)))["p"]
            ).alias("gain"),
        )
        for i, c in enumerate(columns)
    ]
    return walks.select(id_column, F.inline(F.array(*gains))).groupBy(id_column, "feature").agg(F.avg("gain").alias("value"))


def local_surrogate(
    rows: DataFrame, id_column: str, columns: Sequence[str], scorer: Scorer, scales: dict[str, float], draws: int = 200,
    width: float | None = None,
) -> DataFrame:
    """Weights of a weighted linear fit to the model around each row: (id, feature, weight).

    Perturbed rows are scored together; the sums of the normal equations are plain aggregates, and only
    the small solved system per row is Python.
    """
    size = len(columns)
    width = 0.75 * size**0.5 if width is None else width
    spread = rows.select(id_column, *columns).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    noise = {f"_z{i}": F.when(F.col("_draw") == 0, 0.0).otherwise(drawn(F.xxhash64(id_column, "_draw", F.lit(SEED + i)))) for i in range(size)}
    moved = spread.withColumns(noise)
    moved = moved.withColumns({c: F.col(c) + F.col(f"_z{i}") * F.lit(scales[c]) for i, c in enumerate(columns)})
    z = [F.col(f"_z{i}") for i in range(size)]
    distance = sum((v * v for v in z[1:]), z[0] * z[0])
    scored = scorer(assembled(moved, columns)).withColumn("_w", F.exp(-distance / (width * width)))
    terms = [F.lit(1.0), *z]
    w = F.col("_w")
    gram = [F.sum(w * terms[i] * terms[j]) for i in range(size + 1) for j in range(size + 1)]
    sums = scored.groupBy(id_column).agg(F.array(*gram).alias("_a"), F.array(*[F.sum(w * t * F.col("p")) for t in terms]).alias("_b"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        systems = np.stack(a.to_numpy()).reshape(-1, size + 1, size + 1) + 1e-6 * np.eye(size + 1)
        return pd.Series(list(np.linalg.solve(systems, np.stack(b.to_numpy())[..., None])[..., 0]))

    names = F.array(*[F.lit(c) for c in columns])
    solved = sums.select(id_column, solve("_a", "_b").alias("_x"))
    return solved.select(
        id_column, F.inline(F.zip_with(names, F.slice("_x", 2, size), lambda n, v: F.struct(n.alias("feature"), v.alias("weight"))))
    )


def tree_nodes(model, spark) -> DataFrame:
    """The node table of a fitted decision tree, as its saved form holds it."""
    path = scratch_path(spark, "tree")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    data = raw.select("nodeData.*") if "nodeData" in raw.columns else raw
    return data.select(
        "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def decision_paths(df: DataFrame, id_column: str, columns: Sequence[str], nodes: DataFrame, depth: int) -> DataFrame:
    """The conditions each row meets from the root to its leaf: (id, path, prediction).

    A tree of bounded depth has a bounded number of nodes, numbered from the root; they travel with the
    plan as one array, and each level is one projection.
    """
    fields = ["id", "prediction", "leftChild", "rightChild", "feature", "threshold"]
    tree = nodes.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()
    names = F.array(*[F.lit(c) for c in columns])
    walk = df.select(id_column, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")).withColumns(
        {"_tree": tree, "id": F.lit(0), "path": F.array().cast("array<string>")}
    )
    for _ in range(depth):
        at = F.col("_at")
        x = F.get("_x", at["feature"])
        inner = at["leftChild"] >= 0
        left = x <= at["threshold"]
        told = F.concat(F.get(names, at["feature"]), F.when(left, " <= ").otherwise(" > "), F.round(at["threshold"], 4).cast("string"))
        walk = walk.withColumn("_at", F.get("_tree", F.col("id"))).select(
            id_column, "_x", "_tree",
            F.when(inner, F.when(left, at["leftChild"]).otherwise(at["rightChild"])).otherwise(F.col("id")).alias("id"),
            F.when(inner, F.concat("path", F.array(told))).otherwise(F.col("path")).alias("path"),
        )
    return walk.select(id_column, "path", F.get("_tree", F.col("id"))["prediction"].alias("prediction"))
