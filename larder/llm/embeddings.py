"""Embedding near-duplicates by product quantisation: coarse lists, residual codes, table distances, exact rerank.

Unit vectors are assigned to the nearest of a few coarse centroids, and their residuals are coded by subspaces. A query probes
every list that could hold a vector within the distance of the least cosine: such a vector lies at most that far beyond the
plane between the two centroids. Within a list the table distance to a coded vector is off by at most its coding error, which is
stored; what can still be near is compared exactly in double precision. So nothing is lost, whatever the codebooks.

Lists are dealt into blocks of bounded size on both sides, so a list that holds a third of all vectors becomes many tasks.
A block returns sums of links and a spanning forest of its links, never its pairs. Equal vectors are one throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import durable, unit_hash
from larder.llm.components import components

COSINE = 0.98
#: Vectors that the centroids and codes are fitted on, coarse lists, subspaces, codes of a subspace, vectors of a block.
TRAIN_ROWS, LISTS, SUBSPACES, CODES, BLOCK = 4096, 64, 8, 64, 1024
#: Sampled vectors of a length that a quantiser is fitted on at least.
FIT_ROWS = 32
_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def _centres(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from k spread rows; at most as many centres as there are different points."""
    different = np.unique(points, axis=0)
    centres = different[np.random.default_rng(7).permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(1)
        for c in range(len(centres)):
            own = points[nearest == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[np.ndarray]

    def encode(self, vectors: np.ndarray, reach: float):
        """List, codes, coding error, and the lists to probe of every unit vector."""
        far = _squares(vectors, self.centroids)
        own = far.argmin(1)
        between = np.sqrt(_squares(self.centroids, self.centroids))
        probes = far - far[np.arange(len(own)), own][:, None] <= 2 * reach * between[own] + _SLACK
        rest = vectors - self.centroids[own]
        codes = np.stack([_squares(rest[:, cut], book).argmin(1) for cut, book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        return own, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(1)), probes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def table_distances(self, queries: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of queries to coded vectors of a list, summed from tables of the subspaces."""
        rest = queries - self.centroids[which]
        return sum(_squares(rest[:, cut], book)[:, codes[:, s]] for s, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)))


def fit(sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    vectors = unit(sample)
    centroids = _centres(vectors, max(1, min(lists, len(vectors) // 16)))
    rest = vectors - centroids[_squares(vectors, centroids).argmin(1)]
    cuts = np.array_split(np.arange(vectors.shape[1]), min(subspaces, vectors.shape[1]))
    return Quantiser(centroids, [_centres(rest[:, cut], codes) for cut in cuts], cuts)


def _forest(linked: np.ndarray, queries: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Each linked id with the smallest id that it reaches within the block."""
    ids = np.unique(np.concatenate([queries, others]))
    q, x = np.searchsorted(ids, queries), np.searchsorted(ids, others)
    low = np.arange(len(ids))
    while True:
        before = low.copy()
        np.minimum.at(low, q, np.where(linked, low[x][None], len(ids)).min(1))
        np.minimum.at(low, x, np.where(linked, low[q][:, None], len(ids)).min(0))
        low = low[low]
        if (low == before).all():
            return [(int(ids[i]), int(ids[j])) for i, j in enumerate(low) if i != j]


def _compare(quantisers: dict[int, Quantiser], cosine: float):
    reach = np.sqrt(2 - 2 * cosine)

    def block(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        index, asked = group[~group["asks"]], group[group["asks"]]
        if len(index) and len(asked):
            ids, weights, queries = index["rep"].to_numpy(), index["n"].to_numpy(), asked["rep"].to_numpy()
            x = np.frombuffer(b"".join(index["vector"])).reshape(len(index), -1)
            q = np.frombuffer(b"".join(asked["vector"])).reshape(len(asked), -1)
            codes = np.frombuffer(b"".join(index["codes"]), np.uint8).reshape(len(index), -1)
            which, quantiser = int(index["list"].iloc[0]), quantisers.get(x.shape[1])
            far = np.zeros((len(q), len(x))) if quantiser is None else np.sqrt(quantiser.table_distances(q, codes, which))
            rows, places = np.nonzero(far <= reach + index["error"].to_numpy()[None] + 1e-6)
            linked = np.zeros(far.shape, bool)
            for i in range(0, len(rows), 1 << 16):
                r, p = rows[i:i + (1 << 16)], places[i:i + (1 << 16)]
                linked[r, p] = (np.einsum("ij,ij->i", q[r], x[p]) >= cosine) & (queries[r] != ids[p])
            sums = linked @ weights
            out += [(int(queries[i]), None, int(sums[i])) for i in np.flatnonzero(sums)]
            out += [(a, b, None) for a, b in _forest(linked, queries, ids)]
        return pd.DataFrame(out, columns=["rep", "other", "links"]).astype({"rep": "int64", "other": "Int64", "links": "Int64"})

    return block


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, train_rows: int = TRAIN_ROWS, block_rows: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id, n_links (other vectors linked), component_id (smallest id reachable), kept (id is it).

    Rows are compared if their labels and the lengths of their vectors are equal. Null labels, null ids, null or zero vectors and vectors with null or
    non-finite components link with nothing. Repeated rows count one by one and link with each
    other. An empty table gives an empty result; other columns are left out. Quantisers are fitted on about train_rows
    vectors, chosen by a hash of the id, one for each length that has FIT_ROWS of them at least; vectors of rarer lengths form one list each,
    compared exactly. Every vector is indexed and asked.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = rows.where("id IS NOT NULL AND label IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)")
    if good.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    classes = durable(good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    chosen = classes.where(unit_hash("rep") < train_rows / classes.count()).select("vector").limit(2 * train_rows).toPandas()["vector"]
    quantisers = {int(n): fit(np.array(own.tolist(), float)) for n, own in chosen.groupby(chosen.map(len)) if len(own) >= FIT_ROWS}
    shared = spark.sparkContext.broadcast(quantisers)
    reach = float(np.sqrt(2 - 2 * cosine))

    def encode(frames):
        for frame in frames:
            for size, f in frame.groupby(frame["vector"].map(len)):
                v, quantiser = unit(np.array(f["vector"].tolist(), float).reshape(len(f), -1)), shared.value.get(int(size))
                if quantiser is None:
                    own, codes, error, probes = np.zeros(len(f), int), np.zeros((len(f), 0), np.uint8), np.full(len(f), np.inf), np.ones((len(f), 1), bool)
                else:
                    own, codes, error, probes = quantiser.encode(v, reach)
                yield f.drop(columns="vector").assign(
                    size=int(size), list=own, vector=[x.tobytes() for x in v], codes=[c.tobytes() for c in codes], error=error,
                    probes=[np.flatnonzero(p) for p in probes],
                )

    kind = classes.schema["label"].dataType.simpleString()
    coded = durable(classes.mapInPandas(encode, f"label {kind}, rep long, n long, size int, list int, vector binary, codes binary, error double, probes array<int>"))
    sizes = durable(coded.groupBy("label", "size", "list").count().select("label", "size", "list", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    asked = coded.select("label", "size", F.explode("probes").alias("list"), "rep", "vector")
    asked_sizes = durable(asked.groupBy("label", "size", "list").count().select("label", "size", "list", F.ceil(F.col("count") / block_rows).cast("int").alias("asked_blocks")))
    both = durable(sizes.join(asked_sizes, ["label", "size", "list"]))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = coded.join(both, ["label", "size", "list"]).select("label", "size", "list", place("blocks").alias("block"), every("asked_blocks").alias("asked_block"), F.lit(False).alias("asks"), "rep", "n", "vector", "codes", "error")
    asks = asked.join(both, ["label", "size", "list"]).select("label", "size", "list", every("blocks").alias("block"), place("asked_blocks").alias("asked_block"), F.lit(True).alias("asks"), "rep", F.lit(0).cast("long").alias("n"), "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    compare = lambda group: _compare(shared.value, cosine)(group)
    found = durable(index.union(asks).groupBy("label", "size", "list", "block", "asked_block").applyInPandas(compare, "rep long, other long, links long"))
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = durable(
        classes.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    result = rows.withColumn("usable", F.col("id").isNotNull()).join(named.withColumn("usable", F.lit(True)), ["label", "vector", "usable"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def oracle(cosine: float = COSINE) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {cosine} ELSE false END),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""
