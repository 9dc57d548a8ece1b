"""Queries of the vector index and of tables of queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import vector_index as vi
from folioloom.plans import views as v
from folioloom.plans.search import _dist
from folioloom.session import shared_dir, table

CELLS = 24
K = 10


def _built(spark: SparkSession, d: str) -> str:
    at = f"{shared_dir(spark)}/folioloom/vectors-{uuid.uuid4().hex}"
    vi.build(table(spark, d, "embeddings"), at, CELLS, rounds=4, key="vec_id")
    return at


def ivf_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """A search of the stored index that looks into every cell: the exact ranking."""
    found = vi.search(spark, _built(spark, d), v.query_vector(spark, d), 25, probes=CELLS, key="vec_id", key_type="bigint")
    return found.select("vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"), "vrank")


def ivf_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with a length is in one cell of the stored index."""
    rows = vi.stored_rows(spark, _built(spark, d), "vec_id", "bigint")
    return rows.groupBy("vec_id").agg(F.count("*").alias("cells"), F.round(F.max("norm"), 6).alias("norm"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 20, among all, in one pass."""
    found = vi.nearest_many(table(spark, d, "embeddings"), _queries(spark, d), K, key="vec_id")
    return found.select("query_id", "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"), "vrank")


def ivf_many(spark: SparkSession, d: str) -> DataFrame:
    """The same by the stored index, each query in all of its cells."""
    at = _built(spark, d)
    found = vi.nearest_many(vi.stored_rows(spark, at, "vec_id", "bigint"), _queries(spark, d), K, key="vec_id", path=at, probes=CELLS)
    return found.select("query_id", "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"), "vrank")


_MANY_SQL = f"""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id, 1.0 - list_dot_product(r.e, q.e) / (r.norm * q.norm) AS dist FROM n q JOIN n r ON q.norm > 0 AND r.norm > 0 WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS vrank FROM p)
SELECT query_id, vec_id, round(dist, 6) + 0.0::DOUBLE AS dist, vrank FROM k WHERE vrank <= {K}
"""

ALL = [
    (
        "ivf_all_cells",
        ivf_all_cells,
        f"SELECT vec_id, round(dist, 6) + 0.0::DOUBLE AS dist, row_number() OVER (ORDER BY dist, vec_id) AS vrank FROM (SELECT vec_id, {_dist()} AS dist FROM embeddings WHERE embedding IS NOT NULL ORDER BY dist, vec_id LIMIT 25)",
    ),
    ("ivf_cells", ivf_cells, "SELECT vec_id, 1::BIGINT AS cells, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"),
    ("knn_many", knn_many, _MANY_SQL),
    ("ivf_many", ivf_many, _MANY_SQL),
]
