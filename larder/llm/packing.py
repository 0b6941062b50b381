"""Best-fit packing of texts into sequences of fixed length, with conflicts.

A text longer than a sequence is cut; pieces are dealt by a hash into groups of bounded size, and each group is packed on its
own, the longest pieces first. A piece goes into the fullest open bin that still has room and holds neither a piece of its
source nor of its duplicate cluster, nor one with the same words. Open bins are ordered by what is left in them; sources and clusters keep bitmaps of the bins
they are in; the search starts at the piece's length and goes on to the next larger rest until one is compatible.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import neardup
from larder.llm.common import durable, numbered

#: Words of a sequence; pieces of a packing group.
CAPACITY, GROUP = 2048, 2048


def pack(lengths: list[int], sources: list, clusters: list, capacity: int, copies: list | None = None) -> list[int]:
    """Bin of every piece; copies: a second kind of cluster. Ties: longer pieces first, then in the given order; of equal bins the older one."""
    by_rest: dict[int, int] = {}  # rest -> bitmap of bins with that rest
    rests = 0  # bitmap of rests that some bin has
    in_bins: dict[tuple, int] = {}  # source or cluster -> bitmap of bins
    kinds = [("s", sources), ("c", clusters), *([("x", copies)] if copies is not None else [])]
    placed, bins = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, marks = lengths[i], [(k, of[i]) for k, of in kinds if of[i] is not None]
        taken = 0
        for m in marks:
            taken |= in_bins.get(m, 0)
        larger, chosen, rest = rests >> need << need, -1, capacity
        while larger:  # successors in the order of rests
            step = (larger & -larger).bit_length() - 1
            free = by_rest[step] & ~taken
            if free:
                chosen, rest = (free & -free).bit_length() - 1, step
                break
            larger &= larger - 1
        if chosen < 0:
            chosen, bins = bins, bins + 1
        else:
            by_rest[rest] ^= 1 << chosen
            if not by_rest[rest]:
                rests ^= 1 << rest
        left = rest - need
        by_rest[left] = by_rest.get(left, 0) | 1 << chosen
        if left:
            rests |= 1 << left
        for m in marks:
            in_bins[m] = in_bins.get(m, 0) | 1 << chosen
        placed[i] = chosen
    return placed


def _rows(docs: DataFrame, length: Column | None, cluster: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), "")
    folded = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col)).alias("source_key"),
        (F.size(words) if length is None else length).cast("long").alias("length"), F.xxhash64(folded if cluster is None else cluster).alias("copies"),
    )


def pack_rows(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """rows (id, text_key, source_key, length, copies, near) as pieces in bins, see pack_documents; null keys conflict with nothing.

    Rows are numbered by id and keys, so the same rows come to the same bins at any partitioning.
    """
    kind = rows.schema["id"].dataType
    rows = durable(numbered(durable(rows), "id", "text_key", "source_key", "length", "copies", "near"))
    n_pieces = F.ceil(F.col("length") / capacity)
    groups = max(1, math.ceil((rows.where("length > 0").agg(F.sum(n_pieces)).first()[0] or 0) / group_rows))
    empty = rows.where("length IS NULL OR length <= 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_words"))
    start = F.col("piece") * F.lit(capacity).cast("long")
    pieces = rows.where("length > 0").select("*", F.explode(F.sequence(F.lit(0), n_pieces.cast("int") - 1)).alias("piece")).select(
        F.col("id").cast("string").alias("id"), "source_key", "copies", "near", "place", "piece", start.alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("length") - start).alias("n_words"), F.pmod(F.xxhash64("place", "piece"), F.lit(groups)).alias("part"),
    )

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by([("place", "ascending"), ("piece", "ascending")])
        of = {c: g.column(c).to_pylist() for c in ("part", "n_words", "source_key", "copies", "near")}
        bins = pack(of["n_words"], of["source_key"], of["copies"], capacity, of["near"])
        held = Counter()
        for b, n in zip(bins, of["n_words"], strict=True):
            held[b] += n
        names = [f"{of['part'][0]}-{b}" for b in bins]
        return g.select(["id", "piece", "start", "n_words"]).append_column("bin_id", [names]).append_column("bin_words", [[held[b] for b in bins]])

    packed = pieces.groupBy("part").applyInArrow(run, "id string, piece int, start long, n_words long, bin_id string, bin_words long")
    return packed.withColumn("id", F.col("id").cast(kind)).unionByName(empty).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, cluster: Column | None = None,
                   id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group_rows: int = GROUP) -> DataFrame:
    """One row per piece: id, piece (from 0), start, n_words, bin_id, bin_words (words in the bin). Bins hold at most capacity words.

    length: words or tokens of a row (default: words between white space); cluster: equal for duplicates (default: a hash of
    the words). Groups have about group_rows pieces. Null sources conflict with nothing. Null and empty texts give one row with 0 words and no
    bin; repeated rows are packed each and share no bin; null ids stay; an empty table gives an empty result; other columns are left out.
    """
    rows = _rows(docs, length, cluster, id_col, text_col, source_col).withColumn("near", F.lit(None).cast("long"))
    return pack_rows(rows, capacity, group_rows, id_col)


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               group_rows: int = GROUP) -> DataFrame:
    """As pack_documents by words, with near copies (the components of neardup) apart too. Each text is read once, for its words and its fingerprint."""
    source = F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col))
    found = neardup.clusters(docs, id_col, text_col, words=True, source_key=source)
    rows = found.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "text_key", "source_key", F.col("n_words").alias("length"), F.col("words_key").alias("copies"), F.col("cluster").alias("near"))
    return pack_rows(rows, capacity, group_rows, id_col)
