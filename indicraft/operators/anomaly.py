"""Unusual entities: z-score flags, an isolation forest, merged severity, narratives."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import argmax_label, argmin_label
from ..session import attach_stats, materialize
from .bounds import percentile_bounds, quantile_name
from .windows import topk_per_group


def zscore_flags(df: DataFrame, key: str, cols: Sequence[str], z: float = 2.5, minimum_rows: int = 0) -> DataFrame:
    """Keys whose largest |z| over the columns exceeds `z`, with the signed value and its column.

    Population deviation, a constant column counts with deviation 1, rows with a missing
    value are left out. Fewer complete rows than a caller's `minimum_rows` raise when the result is computed.
    """
    full = df.select(key, *cols).dropna(subset=list(cols))
    stats = full.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols],
    )
    entries = []
    for i, c in enumerate(cols):
        sd = F.col(f"_s.sd_{c}")
        score = (F.col(c) - F.col(f"_s.mean_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        entries.append(F.struct(F.abs(score).alias("size"), F.lit(-i).alias("place"), score.alias("z"), F.lit(c).alias("name")))
    worst = attach_stats(full, stats, "_s").withColumn("_w", F.array_max(F.array(*entries)))
    if minimum_rows:
        few = F.raise_error(F.concat(F.lit("complete rows: "), F.col("_s.rows").cast("string"), F.lit(f", at least {minimum_rows} needed")))
        worst = worst.withColumn("_w", F.when(F.col("_s.rows") >= minimum_rows, F.col("_w")).otherwise(few.cast(worst.schema["_w"].dataType)))
    return worst.filter(F.col("_w.size") > z).select(
        key,
        F.col("_w.z").alias("zscore_worst"),
        F.col("_w.name").alias("zscore_trigger_col"),
        F.lit("zscore").alias("detection_method"),
    )


def _path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, cut, left, right, depth) of one random tree; leaves carry an adjusted depth."""
    nodes: list[tuple] = []
    work = [(0, points, 0)]
    next_id = 1
    while work:
        node, pts, depth = work.pop()
        low, high = (pts.min(axis=0), pts.max(axis=0)) if len(pts) else (np.zeros(1), np.zeros(1))
        choices = np.flatnonzero(high > low)
        if depth >= limit or len(pts) <= 1 or choices.size == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + _path_norm(len(pts))))
            continue
        feature = int(rng.choice(choices))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = pts[:, feature] <= cut
        nodes.append((node, feature, cut, next_id, next_id + 1, float(depth)))
        work.append((next_id, pts[goes_left], depth + 1))
        work.append((next_id + 1, pts[~goes_left], depth + 1))
        next_id += 2
    return nodes


NODE = "tree int, node int, feature int, cut double, left_node int, right_node int, depth double"


def grow_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int, size: int, rows: int, seed: int = 42) -> pd.DataFrame:
    """Nodes of random trees, each grown in one task from a hash-chosen sample of `size` of the `rows` complete rows.

    The result has at most trees × 2·size rows, however many `df` has, and can be kept to score later rows.
    """
    names = list(cols)
    # Uniform draw per (row, tree); the share keeps a six-sigma reserve above `size`.
    share = min(1.0, (size + 6 * math.sqrt(size) + 10) / rows)
    draw = lambda t: F.pmod(F.xxhash64(F.col(key), F.lit(seed), t), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = (
        # only the trees that drew a row leave the array
        df.withColumn("drawn", F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw"))), lambda d: d.draw < share))
        .select(key, *names, F.inline("drawn"))
    )
    picked = topk_per_group(drawn, "tree", [F.col("draw"), F.col(key)], size)
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values("draw")[names].to_numpy()
        grown = _grow_tree(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node", "feature", "cut", "left_node", "right_node", "depth"])
        out.insert(0, "tree", tree)
        return out

    return picked.groupBy("tree").applyInPandas(grow, NODE).toPandas().sort_values(["tree", "node"])


def forest_scores(df: DataFrame, cols: Sequence[str], nodes: pd.DataFrame, size: int, out: str = "forest_score") -> DataFrame:
    """Add the isolation score, -2^(-mean depth / usual depth of `size` points): near -1 for rows that stand alone.

    `nodes` has a row per node (`NODE`): tree, node 0 is the root, feature the place in `cols` or -1 in a leaf,
    values up to `cut` go left; a leaf's depth counts. The columns must hold numbers in every row.
    """
    forest = [
        tuple(t.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left_node", "right_node", "depth"))
        for _, t in nodes.groupby("tree")
    ]
    norm = _path_norm(size)

    def isolation(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy(dtype=float)
        depth = np.zeros(len(x))
        for feature, cut, left, right, leaf_depth in forest:
            at = np.zeros(len(x), dtype=np.int64)
            inner = np.flatnonzero(feature[at] >= 0)
            while inner.size:
                here = at[inner]
                smaller = x[inner, feature[here]] <= cut[here]
                at[inner] = np.where(smaller, left[here], right[here])
                inner = inner[feature[at[inner]] >= 0]
            depth += leaf_depth[at]
        return pd.Series(-np.power(2.0, -(depth / len(forest)) / norm))

    def scores(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in it:
            yield isolation(pd.concat(parts, axis=1))

    # the annotations are read as types, which names under `annotations` are not
    scores.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(scores, "double")(*cols))


def isolation_forest(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    trees: int = 150,
    contamination: float = 0.05,
    sample: int = 256,
    seed: int = 42,
    minimum_rows: int = 0,
) -> DataFrame:
    """Keys in the lowest `contamination` share of isolation scores.

    Each tree grows in one task from a hash-chosen sample of at most `sample` rows, so
    no task ever holds more. The forest (trees × 2·sample nodes, a fixed size) goes to
    the executors, which score their rows in Arrow batches.
    """
    cols = list(cols)
    full = materialize(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols), "iforest")
    stats = full.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]
    )
    scaled = attach_stats(full, stats, "_s").select(
        key,
        *[
            ((F.col(c) - F.col(f"_s.mean_{c}")) / F.when(F.col(f"_s.sd_{c}") == 0, 1.0).otherwise(F.col(f"_s.sd_{c}"))).alias(f"x{i}")
            for i, c in enumerate(cols)
        ],
    )
    names = [f"x{i}" for i in range(len(cols))]
    rows = full.count()
    if rows < minimum_rows:
        raise ValueError(f"{rows} complete rows, at least {minimum_rows} needed")
    size = min(sample, rows)
    nodes = grow_forest(scaled, key, names, trees, size, rows, seed)
    scored = materialize(forest_scores(scaled, names, nodes, size, "_score").select(key, "_score"), "iforest")
    cut = percentile_bounds(scored, ["_score"], (contamination,))
    margin = F.col("_score") - F.col(f"_c.{quantile_name('_score', contamination)}")
    return (
        attach_stats(scored, cut, "_c")
        .withColumn("iforest_score", margin)
        .filter(F.col("iforest_score") < 0)
        .select(key, "iforest_score", F.lit("isolation_forest").alias("detection_method"))
    )


def merge_flags(forest: DataFrame, zscores: DataFrame, key: str) -> DataFrame:
    """One row per flagged key; the forest row wins, keys found by both are `both_methods`.

    When one method found nothing at all the severity says which one was alone.
    """
    a = forest.select(key, F.col("iforest_score").alias("_fs"), F.lit(True).alias("_f"))
    b = zscores.select(key, F.col("zscore_worst").alias("_zs"), F.lit(True).alias("_z"))
    any_a = forest.limit(1).agg(F.count(F.lit(1)).alias("n"))
    any_b = zscores.limit(1).agg(F.count(F.lit(1)).alias("n"))
    method = F.when(F.col("_f"), "isolation_forest").otherwise("zscore")
    severity = (
        F.when(F.col("_f") & F.col("_z"), "both_methods")
        .when(any_a.scalar() == 0, "zscore_only")
        .when(any_b.scalar() == 0, "iforest_only")
        .otherwise(method)
    )
    return a.join(b, key, "full").select(
        key,
        F.coalesce("_fs", "_zs").alias("anomaly_score"),
        method.alias("detection_method"),
        severity.alias("severity"),
    )


def narrate(
    df: DataFrame,
    name: str,
    pillars: Sequence[str],
    changes: Mapping[str, str],
    severity: str | None = None,
    gap: float = 30,
    out: str = "narrative",
) -> DataFrame:
    """One-sentence-per-finding text: a wide pillar gap, the largest change, double flags.

    `changes` maps change column to its label; a column named like absenteeism worsens
    when it rises.
    """

    def title(c: str) -> str:
        return c.replace("_score", "").replace("_", " ").title()

    def whole(c: Column) -> Column:
        # ties go to the even digit, as in the published texts
        return F.bround(c, 0).cast("bigint").cast("string")

    labels = {title(c): c for c in pillars}
    high = F.greatest(*[F.col(c) for c in pillars]) if len(pillars) > 1 else F.col(pillars[0])
    low = F.least(*[F.col(c) for c in pillars]) if len(pillars) > 1 else F.col(pillars[0])
    gap_text = F.when(
        high - low > gap,
        F.format_string(
            "Large pillar gap — %s (%s) vs %s (%s), a %s-point spread.",
            argmax_label(labels, null_as=-1e9),
            whole(high),
            argmin_label(labels, null_as=1e9),
            whole(low),
            whole(high - low),
        ),
    )
    parts = [gap_text]
    if changes:
        entries = []
        for i, (c, label) in enumerate(changes.items()):
            up, down = ("worsened", "improved") if "absenteeism" in c else ("increased", "decreased")
            v = F.col(c).cast("double")
            word = F.when(v > 0, up).otherwise(down)
            entries.append(
                F.when(
                    v.isNotNull(),
                    F.struct(
                        F.abs(v).alias("size"),
                        F.lit(-i).alias("place"),
                        F.format_string("%s %s by %.1f points YoY.", F.lit(label.title()), word, F.bround(F.abs(v), 1)).alias("text"),
                    ),
                )
            )
        # array_max skips missing entries
        parts.append(F.array_max(F.array(*entries))["text"])
    if severity:
        parts.append(
            F.when(
                F.col(severity) == "both_methods",
                "Flagged by both Isolation Forest and z-score — high confidence anomaly.",
            )
        )
    body = F.concat_ws(" ", *parts)
    text = F.when(body == "", "Unusual score profile detected.").otherwise(body)
    return df.withColumn(out, F.concat(F.col(name), F.lit(": "), text))
