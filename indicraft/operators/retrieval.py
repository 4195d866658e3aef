"""Vector search: exact cosine top-k, source diversity, context text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import ColumnLike, as_col
from ..session import materialize
from .windows import topk_per_group

#: Queries of one block: 10,000 vectors of 1,024 doubles are 80 MB.
BLOCK_QUERIES = 10_000


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    pairs = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v: ColumnLike) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: ColumnLike) -> Column:
    """Unit-length vector; the zero vector stays as it is."""
    size = l2_norm(v)
    return F.transform(as_col(v), lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))


def cosine_topk(
    queries: DataFrame,
    corpus: DataFrame,
    query_key: str,
    key: str,
    vector: str = "embedding",
    k: int = 5,
    threshold: float = 0.35,
    multiplier: int = 4,
    block: int = BLOCK_QUERIES,
) -> DataFrame:
    """Up to `k · multiplier` best corpus rows per query with cosine ≥ threshold: (query, key, score, place).

    Any number of queries: they are cut into blocks of about `block` by the hash of their key, and
    every block is one search whose matrix travels with the tasks. A task keeps the best rows per
    query over all it reads and sends them on at its end, so the shuffle carries candidates only.
    """
    blocks = max(1, -(-queries.count() // block))
    out = None
    for at in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == at) if blocks > 1 else queries
        found = _search(part, corpus, query_key, key, vector, k * multiplier, threshold)
        # with several blocks each result is stored before the next block is read
        found = materialize(found, "search") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _kept(rows: pd.DataFrame, want: int) -> pd.DataFrame:
    """Best `want` rows per query; copies share a score, so the smallest keys fill the remaining places."""
    return rows.sort_values(["qi", "score", "k"], ascending=[True, False, True], kind="stable").groupby("qi", sort=False).head(want)


def _search(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, vector: str, want: int, threshold: float) -> DataFrame:
    # a block of queries, bounded by `block`
    rows = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).collect()
    query_type, key_type = queries.schema[query_key].dataType, corpus.schema[key].dataType
    matrix = np.array([r["v"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
    if len(rows):
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floor = [], np.full(len(matrix), threshold)
        for batch in batches:
            for start in range(0, batch.num_rows if len(matrix) else 0, 1_024):
                part = batch.slice(start, 1_024)
                usable = pa.array(np.asarray(part.column(1).is_valid()))
                keys = part.column(0).filter(usable)
                if len(keys) == 0:
                    continue
                lines = part.column(1).filter(usable).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                size = np.sqrt(np.einsum("ij,ij->i", lines, lines))
                scores = (lines @ matrix.T) / np.where(size == 0, 1.0, size)[:, None]
                at, q = np.nonzero(scores >= floor)
                if at.size:
                    held.append(pd.DataFrame({"qi": q.astype(np.int32), "k": keys.take(pa.array(at)).to_pandas(), "score": scores[at, q]}))
                if sum(map(len, held)) > 4 * want * len(matrix) + 100_000:
                    held = [_kept(pd.concat(held), want)]
                    full = held[0].groupby("qi")["score"].agg(["size", "min"])
                    full = full[full["size"] == want]
                    floor[full.index.to_numpy()] = full["min"].to_numpy()
        if held:
            yield pa.RecordBatch.from_pandas(_kept(pd.concat(held), want), preserve_index=False)

    hits = corpus.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(best, f"qi int, k {key_type.simpleString()}, score double")
    top = topk_per_group(hits, "qi", [F.col("score").desc(), F.col("k")], want, "place")
    spark = queries.sparkSession
    names = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(rows)], T.StructType([T.StructField("qi", T.IntegerType()), T.StructField(query_key, query_type)]))
    return top.join(names, "qi").select(query_key, F.col("k").alias(key), "score", "place")


def diversity_rerank(hits: DataFrame, query_key: str, source: str, key: str, k: int = 5, boost: float = 1.05) -> DataFrame:
    """Lift hits of sources seen less often than the most frequent one, then keep `k` per query.

    Runs on the candidates of each query, a few dozen rows by construction.
    """
    per_source = F.count(F.lit(1)).over(W.partitionBy(query_key, source))
    counted = hits.withColumn("_n", per_source)
    top = F.max("_n").over(W.partitionBy(query_key))
    lifted = counted.withColumn("_top", top).withColumn(
        "score", F.when(F.col("_n") < F.col("_top"), F.col("score") * boost).otherwise(F.col("score"))
    )
    ranked = topk_per_group(lifted.drop("_n", "_top", "place"), query_key, [F.col("score").desc(), F.col(key)], k, "place")
    return ranked


def assemble_context(hits: DataFrame, query_key: str, source: str, text: str) -> DataFrame:
    """Context block per query: `[Source: s | Relevance: 0.87]` and the text, best first."""
    block = F.format_string("[Source: %s | Relevance: %.2f]\n%s", F.col(source), F.col("score"), F.col(text))
    grouped = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("_b"))
    return grouped.select(query_key, F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n---\n\n").alias("context"))

