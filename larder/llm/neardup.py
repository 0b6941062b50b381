"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a point halfway between them that differs from each in at most half the radius. If every
fingerprint emits all such points (its ball), near ones meet in one; members of one ball centre are all within the radius of
each other, so each is linked to the smallest of them and no pairs are listed. A ball of 64 bits and half radius 2
has 2,081 points. To emit it only where it can matter, a first round hashes small balls on 42 of the bits, three times with
another part of the bits left out: 129 points, shuffled once. A fingerprint that meets no other one there has no
neighbour, and others go on from the points where they met. Equal fingerprints are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import array_of, durable, small_or_shuffled, spare
from larder.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bits of a part that is left out of a key, and how far fingerprints are turned to bring each part to the lowest bits.
PART, TURNS = 22, (0, 21, 42)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_AT_ONCE = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()  # bytes split at blank, tab, LF, VT, FF and CR only


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    runs = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[len(words) - n:].tolist()))
    return np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = np.ascontiguousarray(hashes[i:i + _AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: bool = False, **also: Column) -> DataFrame:
    """id, text_key (hash of the text) and fingerprint (a long with its bits) of every row; null and empty texts have zero.

    words: n_words and words_key (XXH64 of the words) too. also: further columns of docs to carry, by the name they get.
    """
    from xxhash import xxh64_intdigest

    narrow = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), *[c.alias(n) for n, c in also.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"fingerprint": [], "n_words": [], "words_key": []} if words else {"fingerprint": []}
            for text in batch.column(0):
                split = words_of(text.as_py())
                found["fingerprint"].append(fingerprint(shingle_hashes(split)))
                if words:
                    found["n_words"].append(len(split))
                    found["words_key"].append(xxh64_intdigest(b" ".join(split), SEED))
            added = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in found.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], names=[*batch.schema.names[1:], *found])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]]
    return narrow.mapInArrow(run, ", ".join([*kept, "fingerprint long", *(["n_words long", "words_key long"] if words else [])]))


def _masks(bits: int, most: int) -> Column:
    """Every flip of at most so many of the lowest bits."""
    return array_of([sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)], "long")


def _turned(value: Column, by: int) -> Column:
    """A long with its bits turned to the right."""
    return F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, 64 - by)) if by else value


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Different fingerprints -> a, b within the radius that connect all that are within it. radius: 2 or 4.

    Every one of three parts of 22 bits is left out in turn, and the ball of radius 1 on the other 42 bits is emitted (43 points). Of at most
    four differing bits two lie in one part, so near fingerprints are within two of each other beside it, and their point halfway has a
    point there that both emit. The points that several fingerprints emit are completed by flips within the part, as many as the ball
    leaves. Of a million fingerprints spread at random about one in a thousand meets another one by chance.
    """
    half = radius // 2
    low = (1 << PART) - 1
    flips = array_of([0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(PART, 64)], "long")
    tasks = max(1, prints.count() // 8192)
    spread = prints.select("fingerprint").repartition(tasks, "fingerprint")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), _turned(F.col("fingerprint"), by).alias("turned")) for side, by in enumerate(TURNS)])
    near = spread.select(F.inline(sides)).select("side", "turned", F.posexplode(flips).alias("flip", "mask")).select(
        F.col("turned").bitwiseAND(F.lit(~low)).bitwiseXOR(F.col("mask")).bitwiseOR(F.col("side").cast("long")).alias("key"),
        F.col("turned").bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(F.col("flip").cast("long"), 32)).alias("own"),
    )
    met = near.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")  # a fingerprint has a key once
    back = met.select(
        F.col("key").bitwiseAND(F.lit(3)).alias("side"), F.shiftright("own", 32).cast("int").alias("flip"), F.col("own").bitwiseAND(F.lit(low)).alias("rest"),
        F.col("key").bitwiseAND(F.lit(~low)).alias("point"),
    )
    within = F.when(F.col("flip") == 0, _masks(PART, half)).otherwise(_masks(PART, half - 1))
    whole = back.select("side", F.col("point").bitwiseOR(F.col("rest")).alias("centre"), F.element_at(flips, F.col("flip") + 1).alias("mask"), F.explode(within).alias("inner"))
    unturned = lambda value: F.coalesce(*[F.when(F.col("side") == side, _turned(value, (64 - by) % 64)) for side, by in enumerate(TURNS)])
    ball = whole.select(unturned(F.col("centre").bitwiseXOR(F.col("mask"))).alias("fingerprint"), unturned(F.col("centre").bitwiseXOR(F.col("inner"))).alias("point"))
    # no more fingerprints than a ball has points meet in one point
    lowest = ball.select("fingerprint", F.min("fingerprint").over(Window.partitionBy("point")).alias("low"))
    return lowest.where("fingerprint <> low").select(F.col("low").alias("a"), F.col("fingerprint").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, words: bool = False, **also: Column) -> DataFrame:
    """id, text_key, fingerprint, component (its smallest fingerprint), component_id of every row, and what fingerprints adds."""
    printed = durable(fingerprints(docs, id_col, text_col, words, **also))
    classes = durable(printed.groupBy("fingerprint").agg(F.min("id").alias("low")))
    joined = components(links(classes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    of_class = durable(classes.join(joined, "fingerprint", "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("component")))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    named = durable(of_class.join(lowest, "component").select("fingerprint", "component", "component_id"))
    return printed.join(named, "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links).

    Rows of equal fingerprints are linked; texts without words have fingerprint zero and are linked like any other.
    Repeated rows stay; a null id takes part, and a component of null ids alone has a null component_id. An empty table
    gives an empty result; other columns are left out.
    """
    return _grouped(docs, id_col, text_col, radius).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: bool = False, **also: Column) -> DataFrame:
    """One row per row of docs: id, text_key (hash of the text) and cluster, equal for the rows of a component.

    Null ids, ties and repeated rows are rows like any other and share the cluster of their fingerprint; null and empty texts have that of zero. An
    empty table gives an empty result; other columns are left out, whatever their names. words, also: as for fingerprints.
    """
    return _grouped(docs, id_col, text_col, radius, words, **also).withColumnRenamed("component", "cluster").drop("fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, that of the smallest id; columns as they are.

    A group of null ids alone keeps one row. Of several texts with the smallest id, and of repeated rows, one stays.
    """
    own_id, own_key = spare(docs, "_id", "_key")
    rows = durable(_grouped(docs, id_col, text_col, radius).select("id", "text_key", "component"))
    keys = rows.groupBy("component", "id", "text_key").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first"))
    chosen = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key").eqNullSafe(F.col("first"))
    marked = durable(keys.join(durable(first), "component").select(F.col("id").alias(own_id), F.col("text_key").alias(own_key), chosen.alias("stays"), "n"))
    same = docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col]) == F.col(own_key))
    kept = docs.join(small_or_shuffled(marked.where("not stays").select(own_id, own_key)), same, "left_anti")
    repeated = small_or_shuffled(marked.where("stays and n > 1").select(own_id, own_key))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same, "left_semi")
    once = again.withColumn(own_key, F.xxhash64(text_col)).dropDuplicates([id_col, own_key]).drop(own_key)
    return kept.join(repeated, same, "left_anti").unionByName(once)
