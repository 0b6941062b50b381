"""Vector search: exact top-k by cosine similarity, and an approximate variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import batches as bt
from larder.operators.filters import optional_filters, with_embedding

THRESHOLD = 0.5
#: Queries of a block and products of a chunk at most; bytes of query vectors that are sent to every executor.
BLOCK_QUERIES = 1024
CHUNK_ROWS = 2048
BROADCAST_BYTES = 32 << 20
#: Rounding of sums of products of unit vectors.
_SLACK = 1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _packer(chunk_rows: int):
    """Arrow task that packs products of one dimension into chunk rows: unit vectors as bytes, their centre and radius, ids and filter values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                for start in range(0, same.num_rows, chunk_rows):
                    part = same.slice(start, chunk_rows)
                    flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                    unit = _unit(flat.astype(np.float64).reshape(-1, dim))
                    centre = unit.mean(0)
                    radius = float(np.linalg.norm(unit - centre, axis=1).max())
                    one = lambda name: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(name))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), one("id"), one("supplier_id"), one("price"), pa.array([unit.tobytes()]), pa.array([centre.tobytes()]), pa.array([radius])],
                        names=["dim", "ids", "suppliers", "prices", "vectors", "centre", "radius"],
                    )

    return run


class _Block:
    """The queries of one block, and the best rows for them that a task has seen."""

    def __init__(self, asked: pa.StructArray, dim: int, default_limit: int, threshold: float | None):
        self.query_ids, self.limits, self.threshold = asked.field("query_id"), asked.field("result_limit"), -np.inf if threshold is None else threshold
        self.unit = _unit(asked.field("query_embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).T
        self.keep = pc.fill_null(asked.field("result_limit"), default_limit).to_numpy(zero_copy_only=False).astype(int)
        values = zip(*(asked.field(c).to_pylist() for c in ("supplier_filter", "price_min", "price_max")), strict=True)
        self.filtered = [(q, *v) for q, v in enumerate(values) if any(x is not None for x in v)]
        self.kept, self.floor = None, np.full(len(self.keep), -np.inf)

    def hits(self, chunk: dict) -> pd.DataFrame | None:
        """Rows of a chunk above the threshold that may still be among the best of a query."""
        # a row is within the chunk's radius of its centre, so no cosine is above that of the centre by more
        bound = chunk["centre"] @ self.unit + chunk["radius"] + _SLACK
        live = np.flatnonzero(~((bound <= self.threshold) | (bound < self.floor)))
        if not len(live):
            return None
        cosines = chunk["vectors"] @ self.unit[:, live]
        sims = np.floor(cosines * bt.COSINE_SCALE + 0.5) / bt.COSINE_SCALE
        # a row tied with the current last place may still win on its id
        ok = (sims >= self.floor[live]) & ((sims > self.threshold) | np.isneginf(self.threshold))
        place = {q: k for k, q in enumerate(live.tolist())}
        for q, wanted, low, high in self.filtered:
            if (k := place.get(q)) is None:
                continue
            if wanted is not None:  # identifiers stay whole numbers beside NULL
                supplier = chunk["suppliers"]
                ok[:, k] &= pc.fill_null(pc.equal(supplier, pa.scalar(wanted, supplier.type)), False).to_numpy(zero_copy_only=False)
            if low is not None:
                ok[:, k] &= chunk["prices"] >= low
            if high is not None:
                ok[:, k] &= chunk["prices"] <= high
        r, k = np.nonzero(ok)
        return pd.DataFrame({"q": live[k], "id": chunk["ids"].iloc[r].to_numpy(), "similarity": sims[r, k]}) if len(r) else None

    def take(self, new: pd.DataFrame) -> None:
        rows = new if self.kept is None else pd.concat([self.kept, new], ignore_index=True)
        rows = rows.sort_values(["q", "similarity", "id"], ascending=[True, False, True], kind="stable")
        self.kept = rows[rows.groupby("q").cumcount().to_numpy() < self.keep[rows["q"].to_numpy()]]
        last = self.kept.groupby("q")["similarity"].agg(["size", "min"])
        full = last[last["size"].to_numpy() >= self.keep[last.index.to_numpy()]]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def as_batch(self, found: pd.DataFrame) -> pa.RecordBatch:
        q = pa.array(found["q"].to_numpy())
        columns = [self.query_ids.take(q), pa.array(found["id"]), pa.array(found["similarity"]), self.limits.take(q)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "similarity", "result_limit"])


def _scorer(default_limit: int, threshold: float | None, prune: bool):
    """Arrow task over rows of a chunk beside a block of queries; keeps the best rows of its partition for every query.

    Without ``prune`` it passes on every row above the threshold, chunk by chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, _Block] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                dim, key = row["dim"].as_py(), (row["dim"].as_py(), row["block"].as_py())
                if key not in blocks:
                    blocks[key] = _Block(row["asked"].values, dim, default_limit, threshold)
                block = blocks[key]
                found = block.hits({
                    "ids": row["ids"].values.to_pandas(), "suppliers": row["suppliers"].values,
                    "prices": row["prices"].values.to_numpy(zero_copy_only=False).astype(np.float64),
                    "vectors": np.frombuffer(row["vectors"].as_buffer()).reshape(-1, dim), "centre": np.frombuffer(row["centre"].as_buffer()), "radius": row["radius"].as_py(),
                })
                if found is not None and not prune:
                    yield block.as_batch(found)
                elif found is not None:
                    block.take(found)
        for block in blocks.values():
            if block.kept is not None:
                yield block.as_batch(block.kept)

    return run


def vector_hits(
    products: DataFrame,
    queries: DataFrame,
    size: bt.BatchSize,
    threshold: float | None,
    default_limit: int,
    prune: bool = True,
) -> DataFrame:
    """(query_id, id, similarity, result_limit): candidates that hold every query's exact top-k.

    Queries are packed into blocks and products into chunks on the executors, and a join deals every chunk to the blocks of its
    dimension, whatever the number of queries; products are scanned once. The vectors of a small query table go to every executor, so chunks stay
    where they were read; a larger table is dealt by block number, each block beside some of the chunks. A chunk's centre and
    radius tell which queries none of its rows can reach. Rows of another dimension and zero vectors match nothing.
    """
    asked = queries.where(F.col("query_embedding").isNotNull()).select(
        "query_id",
        F.col("query_embedding").cast("array<double>").alias("query_embedding"),
        "supplier_filter",
        F.col("price_min").cast("double").alias("price_min"),
        F.col("price_max").cast("double").alias("price_max"),
        "result_limit",
        F.size("query_embedding").alias("dim"),
    ).where(F.exists("query_embedding", lambda x: x != 0))
    spark, id_kind = products.sparkSession, products.schema["id"].dataType.simpleString()
    n_blocks = -(-2 * size.n // BLOCK_QUERIES) if size.n > BLOCK_QUERIES else 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = asked.groupBy("dim", block).agg(F.collect_list(F.struct(*[c for c in asked.columns if c != "dim"])).alias("asked"))  # a block's queries
    rows = with_embedding(products).select(
        "id", "embedding", "supplier_id", F.col("price").cast("double").alias("price"), F.size("embedding").alias("dim")
    ).where(F.exists("embedding", lambda x: x != 0))
    supplier_kind = products.schema["supplier_id"].dataType.simpleString()
    chunks = rows.mapInArrow(
        _packer(CHUNK_ROWS), f"dim int, ids array<{id_kind}>, suppliers array<{supplier_kind}>, prices array<double>, vectors binary, centre binary, radius double"
    )
    if size.vector_bytes <= BROADCAST_BYTES:
        dealt = chunks.join(F.broadcast(blocks), "dim")
    else:  # each block beside as many shares of the chunks as there are tasks for it
        shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
        share = F.pmod(F.xxhash64("centre", "ids"), F.lit(shares)).cast("int").alias("share")
        copies = chunks.select("*", share, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        dealt = copies.join(blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).hint("shuffle_hash"), ["dim", "block", "share"]).drop("share")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {id_kind}, similarity double, result_limit {queries.schema['result_limit'].dataType.simpleString()}"
    return dealt.mapInArrow(_scorer(default_limit, threshold, prune), schema)


def semantic_top(products, queries, size, threshold, default_limit) -> DataFrame:
    hits = vector_hits(products, queries, size, threshold, default_limit)
    return bt.top_k(hits, [F.desc("similarity"), F.asc("id")], size, default_limit)


def search_semantic_batch(
    products: DataFrame,
    suppliers: DataFrame,
    queries: DataFrame,
    similarity_threshold: float = THRESHOLD,
    result_limit: int = 50,
) -> DataFrame:
    """Nearest products by cosine for a table of query vectors; similarity strictly above the threshold."""
    queries = bt.complete(queries, bt.id_type(suppliers).simpleString())
    size = bt.measure(queries, result_limit)
    best = semantic_top(products, queries, size, similarity_threshold, result_limit)
    best = best.select("query_id", "id", "rank_no", "similarity")
    return bt.attach(best, products, suppliers, bt.PRODUCT_COLUMNS, size.small_hits(size.max_limit))


def single_query(spark, search_text=None, query_embedding=None) -> DataFrame:
    schema = "query_id long, search_text string, query_embedding array<double>"
    return spark.createDataFrame([(0, search_text, query_embedding)], schema)


def search_semantic(
    products: DataFrame,
    suppliers: DataFrame,
    query_embedding: list[float],
    supplier_filter=None,
    price_min=None,
    price_max=None,
    similarity_threshold: float = THRESHOLD,
    result_limit: int = 50,
) -> DataFrame:
    """Vector search for one query; the filters are pushed to the product scan."""
    rows = optional_filters(products, supplier_filter, price_min, price_max)
    one = single_query(products.sparkSession, None, [float(x) for x in query_embedding])
    out = search_semantic_batch(rows, suppliers, one, similarity_threshold, result_limit)
    return out.drop("query_id", "rank_no").orderBy(F.desc("similarity"), F.asc("id"))


def search_approximate(
    products: DataFrame,
    queries: DataFrame,
    similarity_threshold: float = THRESHOLD,
    result_limit: int = 50,
    bucket_length: float = 1.0,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Nearest products through locality-sensitive hashing of unit vectors; may miss some.

    On unit vectors a cosine of s is a distance of sqrt(2 - 2 s), so the threshold carries over.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df, column, *keys):
        nonzero = df.where(F.col(column).isNotNull()).where(F.exists(column, lambda x: x != 0))
        raw = nonzero.select(*keys, array_to_vector(F.col(column).cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="unit", p=2.0).transform(raw).drop("raw")

    queries = bt.complete(queries)
    size = bt.measure(queries, result_limit)
    rows, asked = unit(products, "embedding", "id"), unit(queries, "query_embedding", "query_id", "result_limit")
    hasher = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(rows)
    near = hasher.approxSimilarityJoin(rows, asked, float(np.sqrt(2 - 2 * similarity_threshold)), "distance")
    hits = near.select(
        F.col("datasetB.query_id").alias("query_id"),
        F.col("datasetA.id").alias("id"),
        F.col("datasetB.result_limit").alias("result_limit"),
        bt.cosine_score(1 - F.col("distance") * F.col("distance") / 2).alias("similarity"),
    ).where(F.col("similarity") > similarity_threshold)
    best = bt.top_k(hits, [F.desc("similarity"), F.asc("id")], size, result_limit)
    return best.select("query_id", "id", "rank_no", "similarity")
