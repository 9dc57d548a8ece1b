"""An approximate index of vectors: cells around centres, stored by cell; and many queries at once.

``build`` fits centres by spherical k-means on a sample of at most about ``SAMPLE`` vectors (chosen by a hash of the key), each round being one
pass of partial sums; then every vector goes to the cell of its nearest centre and is written under it, with its length. A search
ranks the centres (``cells`` rows, on the driver), reads the partitions of the nearest ``probes`` cells alone, and ranks what is in them
exactly. How many cells that is by default is measured when the index is built: up to ``ASKED`` of its own vectors are searched for exactly, and the least number
of cells that would have found ``RECALL`` of their nearest is stored. With all cells a search equals ``retrieval.nearest``. Vectors that are null or have no length are in no cell, as no search finds them.

``nearest_many`` takes a table of queries: each task multiplies blocks of vectors by the matrix of queries and holds the k best of each query,
a bounded heap; their union is ranked. No pair of a query and a row is ever a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioloom.functions.vectors import length_of, one_thread
from folioloom.operators.retrieval import nearest
from folioloom.session import ship, staged

CELLS = 256
SAMPLE = 65_536
ROUNDS = 8
#: Neighbours that a search with the stored number of cells finds, of the ``NEAR`` nearest, and queries by which that number is measured.
RECALL = 0.95
NEAR = 10
ASKED = 256
#: Queries of one pass over the vectors; more take more passes.
QUERIES = 4096
#: Rows whose products with queries or centres a task holds at a time, whatever the batches.
_ROWS = 1024


def _unit(vectors):
    import numpy as np

    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column):
    """Rows of an Arrow list column, none of them null, as doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _parts(batches):
    """Batches of at most ``_ROWS`` rows, one at least."""
    one_thread()
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), _ROWS):
            yield batch.slice(at, _ROWS)


def _summed(centres):
    """Partial sums of unit vectors by cell: rows (cell, n, sums)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in _parts(batches):
            if batch.num_rows:
                own = _unit(_matrix(batch.column(0)))
                at = (own @ centres.T).argmax(axis=1)
                np.add.at(sums, at, own)
                n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

    return run


def fit_centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS, key: str = "chunk_id", vector: str = "embedding"):
    """Centres as an array of unit vectors, at most ``cells``; of ``rows`` whose vectors have a length."""
    import numpy as np

    spark = rows.sparkSession
    step = max(1, -(-rows.count() // sample))
    drawn = F.xxhash64(F.col(key).cast("string"))
    some = staged(spark, rows.filter(F.pmod(drawn, F.lit(step)) == 0).select(drawn.alias("_h"), F.col(vector).cast("array<double>").alias("v")), "centres-sample")
    start = some.orderBy("_h").limit(cells).collect()
    if not start:
        return np.zeros((0, 1))
    centres = _unit(np.unique(np.array([r["v"] for r in start]), axis=0))
    for _ in range(rounds):
        parts = some.select("v").mapInArrow(_summed(centres), "cell int, n bigint, sums array<double>").select("cell", F.posexplode("sums").alias("i", "x"))
        moved = {r["cell"]: r["v"] for r in parts.groupBy("cell", "i").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).collect()}
        for cell, v in moved.items():  # a centre without vectors stays
            if any(v):
                centres[cell] = _unit(np.array([v]))[0]
    return centres


def _placed(centres, place: int):
    """The batch with each row's cell; column ``place`` has the vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _parts(batches):
            own = _matrix(batch.column(place)) if batch.num_rows else np.zeros((0, centres.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((own @ centres.T).argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def build(rows: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS, key: str = "chunk_id", vector: str = "embedding") -> None:
    """Store the vectors of ``rows`` by cell under ``path``, and the centres beside them."""
    spark = rows.sparkSession
    ship(spark)
    kept = rows.select(key, F.col(vector).alias("embedding"), length_of(F.col(vector)).alias("norm")).filter("norm > 0")
    centres = fit_centres(kept, cells, sample, rounds, key, "embedding")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    placed = kept.mapInArrow(_placed(centres, 1), f"{fields}, cell int") if len(centres) else kept.withColumn("cell", F.lit(0)).limit(0)
    placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


    _calibrate(spark, path, key, dict(kept.dtypes)[key])


def _calibrate(spark: SparkSession, path: str, key: str, key_type: str) -> None:
    """Store the least number of cells with which ``ASKED`` vectors of the index find ``RECALL`` of their nearest, and the recall of each number."""
    import numpy as np

    centres, rows = centres_of(spark, path), stored_rows(spark, path, key, key_type)
    drawn = F.xxhash64(F.col(key).cast("string"))
    asked = rows.orderBy(drawn, key).limit(ASKED).select(F.xxhash64(F.col(key).cast("string")).alias("query_id"), F.col("embedding").alias("vector")).dropDuplicates(["query_id"])
    asked = staged(spark, asked, "index-queries")
    found = nearest_many(rows, asked, NEAR, key=key).join(rows.select(key, "cell"), key).groupBy("query_id", "cell").agg(F.count("*").alias("n")).collect()  # NEAR rows a query at most
    curve = np.zeros(max(1, len(centres)))
    if found:
        matrix = {r["query_id"]: np.array(r["vector"], float) for r in asked.collect()}
        for r in found:
            order = np.argsort(-(centres @ matrix[r["query_id"]]), kind="stable")
            curve[int(np.flatnonzero(order == r["cell"])[0])] += r["n"]
    recall = np.cumsum(curve) / max(1.0, curve.sum())
    probes = int(np.searchsorted(recall, RECALL)) + 1 if found else 1
    spark.createDataFrame([(probes, [float(x) for x in recall])], "probes int, recall array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def probes_of(spark: SparkSession, path: str) -> tuple[int, list[float]]:
    """The stored number of cells to look into, and the measured recall with one cell, two, and so on."""
    r = spark.read.parquet(f"{path}/probes").first()
    return r["probes"], list(r["recall"])


def centres_of(spark: SparkSession, path: str):
    """The stored centres, a row a cell."""
    import numpy as np

    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], float)


def stored_rows(spark: SparkSession, path: str, key: str = "chunk_id", key_type: str = "string") -> DataFrame:
    return spark.read.schema(f"`{key}` {key_type}, embedding array<float>, norm double, cell int").parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, query: list[float], k: int, probes: int | None = None, key: str = "chunk_id", key_type: str = "string") -> DataFrame:
    """The k nearest rows of the ``probes`` cells nearest to the query (by default as many as the index says), as ``nearest`` gives them: key, dist, vrank."""
    import numpy as np

    centres, probes = centres_of(spark, path), probes or probes_of(spark, path)[0]
    rows = stored_rows(spark, path, key, key_type)
    if len(centres):
        order = np.argsort(-(centres @ np.array(query, float)), kind="stable")[:probes]
        rows = rows.filter(F.col("cell").isin(order.tolist()))
    return nearest(rows, query, k, key)


def _heaps(queries, k: int, allowed):
    """The k best of each query in a task: rows (query, key, dist). ``allowed``: per query the cells that it looks into, or None."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        units, held, kind = _unit(queries), [], None

        def reduced(parts):
            """Of rows (query number, distance, key), each query's k best by distance, then key."""
            q, dist, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((keys, dist, q))
            q, dist, keys = q[order], dist[order], keys[order]
            starts = np.searchsorted(q, q)
            keep = np.arange(len(q)) - starts < k
            return q[keep], dist[keep], keys[keep]

        count, bar = 0, np.full(len(units), np.inf)  # none of a query's k best is beyond its bar
        for batch in _parts(batches):
            kind = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), object if pa.types.is_string(kind) or pa.types.is_large_string(kind) else None)
            norms = pc.cast(batch.column(2), pa.float64()).to_numpy(zero_copy_only=False)
            own = _matrix(batch.column(1)) / norms[:, None]
            cells = batch.column(3).to_numpy(zero_copy_only=False) if allowed is not None else None
            for at in range(0, len(units), 256):
                dist = 1.0 - own @ units[at : at + 256].T
                if cells is not None:
                    dist[~allowed[at : at + 256][:, cells].T] = np.inf
                # a query's k best of the rows, and what ties with the last of them
                upto = bar[at : at + 256]
                if len(dist) >= k:
                    np.minimum(upto, np.partition(dist, k - 1, axis=0)[k - 1] + 1e-12, out=upto)
                row, col = np.nonzero((dist <= upto) & np.isfinite(dist))
                held.append((col + at, dist[row, col], keys[row]))
                count += len(row)
            if count > max(200_000, 2 * k * len(units)):
                held = [reduced(held)]
                count = len(held[0][0])
        if held:
            q, dist, keys = reduced(held)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(keys.tolist(), kind), pa.array(dist)], names=["query", "key", "dist"])

    return run


def nearest_many(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "vector", path: str | None = None, probes: int | None = None) -> DataFrame:
    """The k nearest rows of each query (query, vector): query, key, dist, vrank.

    ``rows`` may come from ``stored_rows``; with the index's ``path``, each query looks into its nearest ``probes`` cells (by default as many as the index says), and cells that none of a
    pass's queries wants aren't read. Queries come to the driver ``QUERIES`` at a time, and each block is one pass.
    """
    import numpy as np

    spark = rows.sparkSession
    ship(spark)
    wanted = queries.select(query, F.col(query_vector).cast("array<double>").alias("v")).filter(length_of(F.col("v")) > 0).orderBy(query)
    have = rows.filter(F.col(vector).isNotNull())
    have = have.select(F.col(key).alias("key"), F.col(vector).alias("v"), (F.col("norm") if "norm" in rows.columns else length_of(F.col(vector))).alias("norm"), *(["cell"] if path else [])).filter("norm > 0")
    centres = centres_of(spark, path) if path else None
    probes = (probes or probes_of(spark, path)[0]) if path else None
    kinds = dict(rows.dtypes)[key], dict(queries.dtypes)[query]
    out, block = None, []

    def passed(block):
        matrix = np.array([r["v"] for r in block])
        allowed, own = None, have
        if centres is not None and len(centres):
            order = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
            allowed = np.zeros((len(block), len(centres)), bool)
            np.put_along_axis(allowed, order, True, 1)
            own = have.filter(F.col("cell").isin(np.flatnonzero(allowed.any(axis=0)).tolist()))
        found = own.mapInArrow(_heaps(matrix, k, allowed), f"query bigint, key {kinds[0]}, dist double")
        names = spark.createDataFrame([(i, r[query]) for i, r in enumerate(block)], f"query bigint, _q {kinds[1]}")
        return found.join(F.broadcast(names), "query").select(F.col("_q").alias(query), F.col("key").alias(key), "dist")  # QUERIES rows at most

    for r in wanted.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            out = passed(block) if out is None else out.unionByName(passed(block))
            block = []
    if block or out is None:
        last = passed(block) if block else spark.createDataFrame([], f"`{query}` {kinds[1]}, `{key}` {kinds[0]}, dist double")
        out = last if out is None else out.unionByName(last)
    rank = F.row_number().over(W.partitionBy(query).orderBy("dist", key))  # k rows a task and query
    return out.withColumn("vrank", rank).filter(F.col("vrank") <= k)
