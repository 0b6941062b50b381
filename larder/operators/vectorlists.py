"""A stored approximate vector index: inverted lists of byte codes, opened only where a query probes.

Vectors are unit vectors dealt to the nearest of some learned centres; a list is a partition of a Parquet table. A search
orders the centres for every query, opens the first ``probes`` lists and bounds each cosine from the byte code of the vector and
the code's own error, so that only rows that may be among the best are compared in full. Which lists are opened is the only
approximation: rows of the opened lists are ranked exactly. The number of probes is measured when the index is written: vectors of the table
ask for their neighbours, an exact search answers, and the places of the neighbours' lists tell how many lists hold the wanted share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.vectors import cosine_similarity
from larder.operators import batches as bt
from larder.operators.filters import with_embedding
from larder.operators.vectors import BLOCK_QUERIES, BROADCAST_BYTES, CHUNK_ROWS, THRESHOLD, semantic_top
from larder.session import cut_lineage

#: Lists at most, rows that centres are learned from, vectors that measure the probes, neighbours of each, wanted share of them.
MAX_LISTS = 2048
TRAIN_ROWS = 16_384
MEASURE_ROWS = 64
MEASURE_TOP = 10
RECALL = 0.95
_SLACK = 1e-9
_FILTERS = ("supplier_filter", "price_min", "price_max")


def _unit(flat, dim: int) -> np.ndarray:
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and holds finite numbers only, with its length."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(column).isNotNull()).where(finite & F.exists(column, lambda x: x != 0)).withColumn("dim", F.size(column))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys that stand in one Arrow batch as one chunk row; no shuffle."""
    names = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key in table.group_by(keys).aggregate([]).to_pylist():
                mask = None
                for k, value in key.items():
                    same = pc.equal(table[k], value)
                    mask = same if mask is None else pc.and_(mask, same)
                part = table.filter(mask).combine_chunks()
                for start in range(0, part.num_rows, CHUNK_ROWS):
                    some = part.slice(start, CHUNK_ROWS).combine_chunks()
                    columns = [some[c].combine_chunks() for c in names]
                    packed = pa.StructArray.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names)
                    chunk = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), packed)
                    yield pa.RecordBatch.from_arrays([pa.array([key[k]], table.schema.field(k).type) for k in keys] + [chunk], names=[*keys, "chunk"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    inner = ",".join(f"{c}:{kinds[c]}" for c in names)
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", chunk array<struct<{inner}>>")


def _train(rounds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "id"])
        dim, lists = int(rows["dim"].iloc[0]), min(int(rows["lists"].iloc[0]), len(rows))
        unit = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        centres = unit[:lists].copy()
        for _ in range(rounds):
            nearest = (unit @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)  # a centre without rows stays
        return pd.DataFrame({"dim": [dim], "lists": [lists], "centres": [centres.tobytes()]})

    return run


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk with the list of the nearest centre, the byte code and the code's distance from the unit vector."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, dim = batch.column("chunk")[i].values, batch.column("dim")[i].as_py()
            centres = np.frombuffer(batch.column("centres")[i].as_buffer()).reshape(-1, dim)
            unit = _unit(rows.field("embedding").flatten(), dim)
            scale = np.abs(unit).max(1) / 127
            code = np.rint(unit / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(unit - code * scale[:, None], axis=1)
            columns = [
                pa.array(np.full(len(unit), dim, np.int32)), pa.array((unit @ centres.T).argmax(1).astype(np.int32)),
                *(rows.field(c) for c in ("id", "supplier_id", "price")),
                pa.array(scale), pa.array(error), pa.array([c.tobytes() for c in code], pa.binary()), rows.field("embedding"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "list", "id", "supplier_id", "price", "scale", "error", "code", "embedding"])


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ``probes`` lists of every query of a chunk, nearest centre first; ties go to the smaller number."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows, dim, probes = batch.column("chunk")[i].values, batch.column("dim")[i].as_py(), batch.column("probes")[i].as_py()
            centres = np.frombuffer(batch.column("centres")[i].as_buffer()).reshape(-1, dim)
            near = np.argsort(-(_unit(rows.field("query_embedding").flatten(), dim) @ centres.T), axis=1, kind="stable")[:, :probes]
            n, p = near.shape
            ids = rows.field("query_id").take(pa.array(np.repeat(np.arange(n), p)))
            columns = [ids, pa.array(np.full(n * p, dim, np.int32)), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(p, dtype=np.int32), n))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "dim", "list", "place"])


def _bounds(default_limit: int, threshold: float | None):
    """Arrow task over a chunk of codes beside the queries that probe its list: rows that may be among a query's best."""
    least = -np.inf if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, rows, asked = batch.column("dim")[i].as_py(), batch.column("chunk")[i].values, batch.column("asked")[i].values
                codes = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.int8).reshape(-1, dim).astype(np.float64)
                scale, error = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("scale", "error"))
                about = (codes @ _unit(asked.field("query_embedding").flatten(), dim).T) * scale[:, None]
                limits = pc.fill_null(asked.field("result_limit"), default_limit).to_numpy(zero_copy_only=False).astype(int)
                price, supplier = rows.field("price").to_numpy(zero_copy_only=False).astype(np.float64), rows.field("supplier_id")
                filters = zip(*(asked.field(c).to_pylist() for c in _FILTERS), strict=True)
                picked = []
                for q, (wanted, low, high) in enumerate(filters):
                    ok = about[:, q] + error + _SLACK > least
                    if wanted is not None:
                        ok &= pc.fill_null(pc.equal(supplier, pa.scalar(wanted, supplier.type)), False).to_numpy(zero_copy_only=False)
                    if low is not None:
                        ok &= price >= low
                    if high is not None:
                        ok &= price <= high
                    at = np.flatnonzero(ok)
                    if limits[q] < 1:
                        continue
                    if len(at) > limits[q]:  # beyond the best lower bounds, only what can still reach the last of them
                        lower = about[at, q] - error[at]
                        last = np.partition(lower, len(at) - limits[q])[len(at) - limits[q]]
                        at = at[about[at, q] + error[at] + _SLACK >= last - _SLACK]
                    picked.append((np.full(len(at), q), at))
                if not picked:
                    continue
                q, at = (np.concatenate(x) for x in zip(*picked, strict=True))
                take, value, width = pa.array(at), about[at, q], error[at] + _SLACK
                columns = [
                    asked.field("query_id").take(pa.array(q)), rows.field("id").take(take), pa.array(np.full(len(at), dim, np.int32)),
                    pa.array(np.full(len(at), batch.column("list")[i].as_py(), np.int32)), pa.array(value - width), pa.array(value + width),
                    asked.field("result_limit").take(pa.array(q)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "dim", "list", "lower", "upper", "result_limit"])

    return run


def _list_orders(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """(query_id, dim, list, place): the lists that every query opens. ``centres``: one row a dimension with centres and probes.

    A dimension's centres are MAX_LISTS vectors at most; Spark picks the join from their size.
    """
    asked = _usable(queries, "query_embedding").select("dim", "query_id", F.col("query_embedding").cast("array<double>").alias("query_embedding"))
    kind = queries.schema["query_id"].dataType.simpleString()
    beside = _packed(asked, ["dim"]).join(centres.select("dim", "centres", "probes"), "dim")
    return beside.mapInArrow(_orders, f"query_id {kind}, dim int, list int, place int")


def write_vector_index(products: DataFrame, path: str, recall: float = RECALL, rounds: int = 10, max_lists: int = MAX_LISTS) -> None:
    """Write ``path/rows`` (partitions dim, list), ``path/centres`` and ``path/index`` (a row a dimension: rows, lists, probes).

    A dimension gets as many lists as the root of its rows, ``max_lists`` at most. Centres are learned from TRAIN_ROWS rows a dimension at
    most, chosen by a hash of the id; all rows are indexed. Null and zero vectors, and ones with null or non-finite components, are left
    out. Equal ids stay as they are. An empty table gives an empty index.
    """
    spark = products.sparkSession
    kinds = {c: products.schema[c].dataType.simpleString() for c in ("id", "supplier_id")}
    rows = _usable(with_embedding(products), "embedding").select(
        "dim", "id", "supplier_id", F.col("price").cast("double").alias("price"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("lists", F.least(F.lit(max_lists), F.ceil(F.sqrt("n"))).cast("int"))
    hashed = rows.select("dim", "id", "embedding", F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("h"))
    # a little more than the wanted rows pass the hash, so that the window sorts few
    some = hashed.join(sizes, "dim").where(F.col("h") * F.col("n") < 1.2e6 * TRAIN_ROWS)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("h", "id"))).where(F.col("r") <= TRAIN_ROWS)
    trained = some.groupBy("dim").applyInPandas(_train(rounds), "dim int, lists int, centres binary")
    trained.write.mode("overwrite").parquet(f"{path}/centres")
    centres = spark.read.parquet(f"{path}/centres")
    schema = f"dim int, list int, id {kinds['id']}, supplier_id {kinds['supplier_id']}, price double, scale double, error double, code binary, embedding array<float>"
    dealt = _packed(rows, ["dim"]).join(centres, "dim").mapInArrow(_assign, schema)
    ordered = dealt.repartitionByRange("dim", "list", "id").sortWithinPartitions("dim", "list", "id")
    ordered.write.mode("overwrite").partitionBy("dim", "list").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    # vectors of the table ask for their neighbours: where do the lists of these stand in the order of lists?
    few = stored.select("dim", "id", "embedding", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", F.lit(7)), "id")).alias("r"))
    asks = bt.complete(few.where(F.col("r") <= MEASURE_ROWS).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")).dropDuplicates(["query_id"]), kinds["supplier_id"])
    asks.write.mode("overwrite").parquet(f"{path}/asked")
    asks = spark.read.parquet(f"{path}/asked")
    true = semantic_top(stored, asks, bt.measure(asks, MEASURE_TOP + 1), None, MEASURE_TOP + 1).where("query_id <> id")
    true = cut_lineage(true.select("query_id", "id"))  # MEASURE_ROWS * MEASURE_TOP rows a dimension
    places = _list_orders(asks, centres.withColumn("probes", F.col("lists")))
    met = true.join(stored.select("id", "dim", "list"), "id").join(places, ["query_id", "dim", "list"])
    wanted = met.groupBy("dim").agg(F.expr(f"percentile_disc({float(recall)}) WITHIN GROUP (ORDER BY place)").alias("p"))
    index = sizes.drop("lists").join(centres.select("dim", "lists"), "dim").join(wanted, "dim", "left").select(
        "dim", "n", "lists", (F.coalesce("p", F.lit(0)) + 1).cast("int").alias("probes"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    )
    index.write.mode("overwrite").parquet(f"{path}/index")


def read_vector_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a stored index, and its centres with their measured probes."""
    index = spark.read.parquet(f"{path}/index")
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("id", "supplier_id")}
    schema = f"id {kinds['id']}, supplier_id {kinds['supplier_id']}, price double, scale double, error double, code binary, embedding array<float>, dim int, list int"
    return spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres").join(index.select("dim", "probes"), "dim")


def candidates(rows: DataFrame, centres: DataFrame, queries: DataFrame, threshold: float | None, result_limit: int, size: bt.BatchSize) -> DataFrame:
    """(query_id, id, dim, list, lower, upper, result_limit): rows of the opened lists that may be among a query's best.

    Only codes and filter columns are read. The lists that no query opens are pruned at run time, also for a table of queries.
    """
    opened = _list_orders(queries, centres)
    n_blocks = -(-2 * size.n // BLOCK_QUERIES) if size.n > BLOCK_QUERIES else 1
    asked = _usable(queries, "query_embedding").select(
        "query_id", F.col("query_embedding").cast("array<double>").alias("query_embedding"), "supplier_filter",
        F.col("price_min").cast("double").alias("price_min"), F.col("price_max").cast("double").alias("price_max"), "result_limit",
    )
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")
    blocks = opened.drop("place").join(asked, "query_id").groupBy("dim", "list", block).agg(F.collect_list(F.struct(*asked.columns)).alias("asked")).drop("block")
    # at most as many rows as the index has lists
    lists = opened.where(F.col("list") >= 0).select("dim", "list").distinct()
    codes = rows.select("dim", "list", "id", "supplier_id", "price", "scale", "error", "code").join(F.broadcast(lists), ["dim", "list"], "left_semi")
    probes = centres.agg(F.coalesce(F.max("probes"), F.lit(1))).first()[0]
    small = size.vector_bytes * probes <= BROADCAST_BYTES
    beside = _packed(codes, ["dim", "list"]).join(F.broadcast(blocks) if small else blocks.hint("merge"), ["dim", "list"])
    kinds = {"q": queries.schema["query_id"], "id": rows.schema["id"], "k": queries.schema["result_limit"]}
    kinds = {c: f.dataType.simpleString() for c, f in kinds.items()}
    found = beside.mapInArrow(_bounds(result_limit, threshold), f"query_id {kinds['q']}, id {kinds['id']}, dim int, list int, lower double, upper double, result_limit {kinds['k']}")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower"), "id"))
    limit = F.coalesce("result_limit", F.lit(result_limit))
    last = F.min(F.when(F.col("place") <= limit, F.col("lower"))).over(Window.partitionBy("query_id"))
    return found.withColumn("place", place).withColumn("last", last).where(F.col("upper") >= F.col("last")).drop("place", "last")


def search_lists(
    rows: DataFrame, centres: DataFrame, queries: DataFrame, similarity_threshold: float | None = THRESHOLD, result_limit: int = 50, probes: int | None = None
) -> DataFrame:
    """Nearest rows of a stored index for a table of queries: (query_id, id, rank_no, similarity), similarity strictly above the threshold.

    Similarities are exact and every row of the opened lists that belongs to the best is returned; rows of other lists are missed. ``probes``
    replaces the measured number of lists. A query's filters may leave fewer rows than asked for in its lists: raise ``probes`` then, all lists give
    the exact result. Queries whose vector is null, zero, not finite or of a length that the index lacks find nothing.
    """
    queries = bt.complete(queries, rows.schema["supplier_id"].dataType.simpleString())
    size = bt.measure(queries, result_limit)
    if probes is not None:
        centres = centres.withColumn("probes", F.lit(probes))
    near = candidates(rows, centres, queries, similarity_threshold, result_limit, size).select("query_id", "id", "dim", "list", "result_limit")
    vectors = rows.select("dim", "list", "id", "embedding")
    if size.small_hits(4 * size.max_limit):  # equal bounds can leave more rows than limits; AQE decides beyond
        near = near.hint("broadcast")
    full = vectors.join(near, ["dim", "list", "id"]).join(queries.select("query_id", "query_embedding"), "query_id")
    hits = full.select("query_id", "id", "result_limit", bt.cosine_score(cosine_similarity(F.col("embedding"), F.col("query_embedding"))).alias("similarity"))
    if similarity_threshold is not None:
        hits = hits.where(F.col("similarity") > similarity_threshold)
    best = bt.top_k(hits, [F.desc("similarity"), F.asc("id")], size, result_limit)
    return best.select("query_id", "id", "rank_no", "similarity")
