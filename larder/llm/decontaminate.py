"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check of shingles.

An item leaks where a window of as many words as the item reaches the given similarity: shingles of five words, weighted
by how often they occur, sum of the smaller weights over the sum of the larger ones. Steps:

1. Seeds. A window that is similar enough lacks at most a fifth of an item's shingles, so it holds one of any fifth and one
   more; the rarest are taken. Of all windows of the item's size that hold a seed, in whatever order their words stand, those
   are laid that hold as many of the item's shingles as the similarity takes. No window that would pass is lost here, and
   words far from any benchmark text cost one lookup.
2. Fingerprints of the windows, 64 bits.
3. Four blocks of 16 bits. Two fingerprints within the radius have a block within a quarter of it. Items emit every
   variant of a block within two bits, windows those within the rest; equal variants collide.
4. Colliding pairs within the radius are checked with the exact similarity.

Items of few shingles go from step 1 straight to the exact check: a bit of such a fingerprint rests on few votes, and one lost
shingle can turn more bits than the radius allows.

DataFrame functions only. Items with fewer words than a shingle count as one shingle of all their words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import array_of, durable, small_or_shuffled, spare

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of fingerprints that are still compared: two sets of similarity 0.8 differ in 10 of 64 on average, and
#: in over 19 in at most 1.5 of a thousand from 16 shingles on (simulated). Multiple of four, minus one.
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
#: Items of fewer shingles are checked without fingerprints: of 5 shingles 1.1 % of such pairs lie beyond the radius, of 15 0.2 %.
EXACT_UNDER = 16
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Letters and digits in lower case; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def shingles_of(words: str, size: int) -> Column:
    """Hash of every run of so many words of the column, repeats included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    if size == 1:
        return hashed
    return F.transform(places, lambda i: F.xxhash64(*[F.xxhash64(F.get(words, i + k)) for k in range(size)]))


FINGERPRINT = (
    "aggregate(sequence(0, 63), 0L, (bits, j) -> bits | if("
    "2 * aggregate(bag, 0L, (n, h) -> n + (shiftright(h, j) & 1L)) > size(bag), shiftleft(1L, j), 0L))"
)


def _ball(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _variants(df: DataFrame, radius: int, name: str) -> DataFrame:
    """A row for each block and each flip of at most so many of its bits: block, variant, and the flip as name."""
    blocks = F.array(*[
        F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fingerprint", b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bits"))
        for b in range(BLOCKS)
    ])
    return (
        df.select("*", F.inline(blocks)).select("*", F.explode(array_of(_ball(radius), "long")).alias(name))
        .withColumn("variant", F.col("bits").bitwiseXOR(F.col(name)))
    )


def _overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of what two arrays share; the size of the intersection where nothing repeats."""
    n = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    once = lambda values: F.size(F.array_distinct(values)) == F.size(values)
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, x: total + F.least(n(a, x), n(b, x)))
    return F.when(once(a) & once(b), F.size(F.array_intersect(a, b))).otherwise(counted)


def _first_near_block(differing: Column, most: int) -> Column:
    """The first block with at most so many differing bits."""
    found = F.lit(None).cast("int")
    for b in reversed(range(BLOCKS)):
        bits = F.shiftrightunsigned(differing, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        found = F.when(F.bit_count(bits) <= most, b).otherwise(found)
    return found


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per different word sequence: item (its smallest id), item_key, n_words, and the words."""
    words = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return words.groupBy("words").agg(F.min("item").alias("item")).select(
        "item", F.xxhash64("words").alias("item_key"), F.size("words").alias("n_words"), "words"
    )


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Which id stands for each item in find_leaks: item, and its class, the smallest id of the items of the same words.

    One row per different pair. Items without words are a class each on their own and never leak; null ids stay, and a class of
    null ids alone is null. An empty table gives an empty result.
    """
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).withColumn("words_key", F.xxhash64("words"))
    least = items.where(F.size("words") > 0).groupBy("words").agg(F.min("item").alias("class"))
    least = least.select(F.xxhash64("words").alias("class_key"), "class")
    joined = items.join(least, F.col("words_key") == F.col("class_key"), "left")
    return joined.select("item", F.when(F.size("words") > 0, F.col("class")).otherwise(F.col("item")).alias("class")).distinct()


def _windows(docs: DataFrame, items: DataFrame, size: int, similarity: float) -> DataFrame:
    """Windows that hold enough shingles of an item: id, text_key, start, n_words, bag (the window's shingles), and
    item_key where the item has fewer than EXACT_UNDER shingles; otherwise null, and a window is one row whatever its items."""
    bags = items.select("item_key", "n_words", shingles_of("words", size).alias("bag"))
    places = bags.select("item_key", "n_words", F.size("bag").alias("n"), F.posexplode("bag").alias("place", "shingle"))
    seen_in = places.groupBy("shingle").agg(F.countDistinct("item_key").alias("seen_in"))
    ranked = places.join(seen_in, "shingle").groupBy("item_key", "n_words", "n").agg(
        F.sort_array(F.collect_list(F.struct("seen_in", "place", "shingle"))).alias("ranked")
    )
    lacking = F.floor((1 - similarity) * F.col("n") + 1e-9).cast("int")
    seeds = small_or_shuffled(ranked.select("item_key", "n_words", F.inline(F.slice("ranked", F.lit(1), lacking + 1))).select("shingle", "item_key", "n_words").distinct())
    hits = docs.select("id", "text_key", F.posexplode(shingles_of("words", size)).alias("at", "shingle")).join(seeds, "shingle")
    # the seeds of an item in a stretch of as many words; a window that holds one reaches no further than its own length from it
    stretch = F.floor(F.col("at") / F.col("n_words")).alias("stretch")
    near = hits.groupBy("id", "text_key", "item_key", "n_words", stretch).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    grouped = small_or_shuffled(near.groupBy("id", "text_key").agg(F.collect_list(F.struct("item_key", "n_words", "low", "high")).alias("near")), F.size("near"))
    span, first = F.col("n_words") - size, F.greatest(F.lit(0), F.col("low") - (F.col("n_words") - size))
    known = small_or_shuffled(bags.select("item_key", F.col("bag").alias("item_bag")), F.size("item_bag"))
    ranges = (
        docs.join(grouped.withColumnsRenamed({"id": "w_id", "text_key": "w_key"}), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))
        .select("id", "text_key", shingles_of("words", size).alias("shingles"), "near")
        .select("id", "text_key", "shingles", F.inline("near"))
        .select("id", "text_key", "item_key", "n_words", F.size("shingles").alias("total"), first.alias("first"),
                F.slice("shingles", first + 1, F.col("high") - first + span + 1).alias("part"))
        .join(known, "item_key")
    )
    # overlap / (window + item - overlap) reaches the similarity from this overlap on
    wanted = similarity * (F.least("total", F.size("item_bag")) + F.size("item_bag")) / (1 + similarity)
    # an item's shingle that the range lacks is lacking in every window of it
    enough = F.size(F.array_intersect("part", "item_bag")) >= F.size(F.array_distinct("item_bag")) - F.size("item_bag") + F.col("needed")
    held = F.filter(F.sequence(F.lit(0), F.size("part") - 1), lambda i: F.array_contains("item_bag", F.get("part", i)))
    found = ranges.withColumn("needed", F.ceil(wanted - 1e-9).cast("int")).where(enough).select("*", F.explode(F.array(held)).alias("held"))
    last = F.greatest(F.col("first"), F.col("first") + F.size("part") - 1 - span)  # windows beyond the range hold no seed of it

    def around(i: Column) -> Column:
        """Starts of windows that hold the needed number of places from the i-th on."""
        low = F.greatest(F.col("first"), F.col("first") + F.get("held", i + F.col("needed") - 1) - span)
        high = F.least(last, F.col("first") + F.get("held", i))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("held") - F.col("needed")), around)))
    return (
        found.where(F.size("held") >= F.col("needed"))
        .withColumn("item_key", F.when(F.size("item_bag") < EXACT_UNDER, F.col("item_key")))
        .select("id", "text_key", "item_key", "n_words", "first", "part", F.explode(starts).alias("start"))
        .select("id", "text_key", "item_key", "start", "n_words", F.slice("part", F.col("start") - F.col("first") + 1, span + 1).alias("bag"))
        .groupBy("id", "text_key", "item_key", "start", "n_words").agg(F.first("bag").alias("bag"))
    )


def _leaks_of_size(docs: DataFrame, items: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    per_block, few = radius // BLOCKS, EXACT_UNDER + size - 1  # words of the shortest item that takes fingerprints
    shorter, longer = F.col("n_words") < few, F.col("n_words") >= few
    windows = durable(_windows(docs, items, size, similarity))
    prints = windows.where(longer).drop("item_key").withColumn("fingerprint", F.expr(FINGERPRINT))
    wanted = items.select("item", "item_key", "n_words", shingles_of("words", size).alias("bag")).withColumn("fingerprint", F.expr(FINGERPRINT))
    known = small_or_shuffled(_variants(wanted.where(longer), min(2, per_block), "item_flip").select(
        "item_key", "n_words", "block", "variant", "item_flip", F.col("fingerprint").alias("item_print")
    ))
    bags = small_or_shuffled(wanted.select("item", "item_key", F.col("bag").alias("item_bag")), F.size("item_bag"))
    # A pair meets once: in its first near block, whose two lowest differing bits the item flips and the window the others.
    both, window_flip = F.col("fingerprint").bitwiseXOR(F.col("item_print")), F.col("window_flip")
    pairs = (
        _variants(prints, max(0, per_block - 2), "window_flip").join(known, ["n_words", "block", "variant"])
        .where((window_flip == 0) | (F.col("item_flip") < window_flip.bitwiseAND(-window_flip)) & (F.bit_count("item_flip") == 2))
        .where((F.bit_count(both) <= radius) & (_first_near_block(both, per_block) == F.col("block")))
        .select("id", "text_key", "start", "n_words", "bag", "item_key")
        .union(windows.where(shorter).select("id", "text_key", "start", "n_words", "bag", "item_key"))
        .join(bags, "item_key")
    )
    # as a generator the overlap is computed once, above the join
    return (
        pairs.select("*", F.explode(F.array(_overlap(F.col("bag"), F.col("item_bag")))).alias("shared"))
        .withColumn("similarity", F.col("shared") / (F.size("bag") + F.size("item_bag") - F.col("shared")))
        .where(F.col("similarity") >= similarity - 1e-12)
        .groupBy("id", "text_key", "item", "item_key", "n_words")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        .select("id", "text_key", "item", F.col("n_words").alias("n_words"), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start_word"))
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text",
               similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of text and item: id, text_key (hash of the text), item, n_words, similarity, start_word (first best window).

    Items of the same words are one item with their smallest id, see item_classes for the others; rows of docs with the same id and text are one text, null
    ids included. Null or empty texts and items match nothing; without items or texts the result is empty. Texts shorter
    than an item are one window. Of equally similar windows the first is given.
    """
    items = durable(_items(benchmark, item_id_col, item_text_col))
    texts = _keyed(docs, id_col, text_col)
    sizes = [r[0] for r in items.select(F.least("n_words", F.lit(SHINGLE)).alias("size")).distinct().collect()]  # at most five
    found = [_leaks_of_size(texts, items.where(F.least("n_words", F.lit(SHINGLE)) == size), size, similarity, radius) for size in sorted(sizes)]
    if not found:
        found = [texts.limit(0).select("id", "text_key", F.lit(None).cast("long").alias("item"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("start_word"))]
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs without the rows whose text leaks an item; columns as they are, null ids kept unless their text leaks."""
    own_id, own_key = spare(docs, "_leak_id", "_leak_key")
    leaks = find_leaks(docs, benchmark, id_col, text_col, **settings).select(F.col("id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    return docs.join(small_or_shuffled(leaks), docs[id_col].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text_col]) == F.col(own_key)), "left_anti")
