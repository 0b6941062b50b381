"""Packing into token sequences as a cutting-stock problem, solved by column generation.

Documents become pieces of at most one sequence; the histogram of piece lengths, in classes of a few tokens, is all that the
linear program sees. Its columns are patterns (how many pieces of each class share a sequence); a knapsack by dynamic programming finds
the pattern that the current prices of the classes make most worth while, until none beats its sequence. A class can also be
covered by cutting a piece at powers of two: such parts fill sequences without padding, at a price for each cut. Patterns are
rounded down, and what is left of each class goes into patterns made from the pieces that remain. Pieces are ranked by
(class, id) over many tasks; a pattern owns ranges of ranks, so a place in the order is all that a piece needs to find its sequence.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import durable, numbered

#: Tokens of a sequence, tokens of a class, the id that ends a document, the price of a cut in sequences.
SEQUENCE, CLASS, END, CUT_PRICE = 4096, 8, 2, 1 / 32
#: Words that a worker keeps the ids of, and the gap to the best possible plan at which the program stops.
WORDS, GAP = 800_000, 1e-4
#: Patterns that one pricing offers.
AT_ONCE = 24
_SIMPLE = re.compile("[!-~\u00c0-\u00ff]+").fullmatch  # no character that normalising joins with another
_PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,parts:array<bigint>>>"


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit integers, by a tokenizer that looks at one word at a time.

    White space never joins what stands around it, so the ids of a text are those of its words in turn, and those of a word of
    printable Latin characters are those of the matches of the tokenizer's own pattern, each as the model reads it. Other words are encoded by
    the tokenizer, and so are whole texts with a special token. Tables of words and matches are emptied when full.
    A tokenizer of another kind is asked for whole texts.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, settings = Tokenizer.from_str(source), json.loads(source)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        kinds = [[part["type"] for part in (settings[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
        self.by_words = kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]
        if self.by_words:
            split, level = settings["pre_tokenizer"]["pretokenizers"]
            self.by_words = split["behavior"] == "Removed" and split["invert"] and not (level["add_prefix_space"] or level["use_regex"])
            self.matches = regex.compile(split["pattern"]["Regex"])
            self.level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mark = os.path.commonprefix(self.special)
        self.words = _Words(self._word)
        self.parts = _Words(self._part)

    def _encode(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        seen = part if part.isascii() else self.level.pre_tokenize_str(part)[0][0]
        return array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _SIMPLE(text) is None or self.mark in word:
            return self._encode(word)
        lowered = text.lower()
        if lowered.isalpha():
            return self.parts[lowered]
        return b"".join([self.parts[part] for part in self.matches.findall(lowered)])

    def of(self, text: bytes) -> bytes:
        if not self.by_words or self.mark in text and any(s in text for s in self.special):
            return self._encode(text)
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.parts) > WORDS:
            self.parts.clear()
        return b"".join(map(self.words.__getitem__, text.split()))  # at ASCII white space


class _Words(dict):
    """A table that asks for the words it lacks."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.ask(word)
        return found


_loaded: dict[str, Ids] = {}


def ids_of(tokenizer: str, source: str) -> Ids:
    """The tokenizer of this path, one for each Python worker, so that its tables serve all tasks that the worker runs."""
    if tokenizer not in _loaded:
        _loaded[tokenizer] = Ids(source)
    return _loaded[tokenizer]


def cut(ids: bytes, sequence: int = SEQUENCE) -> list[tuple]:
    """Pieces of a document's ids: start, length, crc32, and the crc32 of the parts that the set bits of the length make, longest first."""
    data, pieces = memoryview(ids), []
    for start in range(0, len(ids) // 4, sequence):
        piece = data[4 * start:4 * (start + sequence)]
        length, at, parts = len(piece) // 4, 0, []
        for bit in reversed(range(length.bit_length())):
            if length >> bit & 1 and length < sequence:
                parts.append(crc32(piece[4 * at:4 * (at + (1 << bit))]))
                at += 1 << bit
        pieces.append({"start": start, "length": length, "ids_crc32": crc32(piece), "parts": parts})
    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """id, doc_tokens, start, length, ids_crc32, parts of every piece; tokenizer: the path of its file, read by the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer, source.value)
        for batch in batches:
            texts, counts, found = batch.column(1), [], []
            for row in range(batch.num_rows):
                data = ids.of(texts[row].as_py() or b"") + last
                counts.append(len(data) // 4)
                found.append(cut(data, sequence))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("parts", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["id", "doc_tokens", "pieces"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, doc_tokens long, pieces {_PIECES}").select("id", "doc_tokens", F.inline("pieces"))


def priced_patterns(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int = AT_ONCE) -> tuple[float, list[np.ndarray]]:
    """Knapsack with any number of each class: the greatest value, and the counts of the best patterns that hold one class or another."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            tried = best[room - sizes[:fits[room]]] + values[:fits[room]]
            k = int(tried.argmax())
            if tried[k] > best[room] + 1e-12:
                best[room], last[room] = tried[k], k
    with_class = values + best[capacity - sizes]
    found: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-with_class, kind="stable")[:most].tolist():
        counts, room = np.zeros(len(sizes)), capacity - int(sizes[first])
        counts[first] = 1
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                counts[last[room]] += 1
                room -= int(sizes[last[room]])
        found[counts.tobytes()] = counts
    return float(best[capacity]), list(found.values())


def fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each class fill the room best, out of those left; the larger classes first where fills are equal."""
    reached, steps = 1, []
    within = (1 << room + 1) - 1
    for k in reversed(range(len(sizes))):
        most, part = min(left[k], room // sizes[k]), 1
        while most and not reached >> room & 1:
            part = min(part, most)
            steps.append((k, part, reached))
            reached |= reached << part * sizes[k] & within
            most, part = most - part, 2 * part
    counts, total = [0] * len(sizes), reached.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> total & 1:
            counts[k] += part
            total -= part * sizes[k]
    return counts


def first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns to start from: the fullest about the largest class left, as often as its classes last."""
    left, found = demand.astype(np.int64).tolist(), []
    while any(left):
        large = max(k for k, n in enumerate(left) if n)
        left[large] -= 1
        counts = fullest(sizes.tolist(), left, capacity - int(sizes[large]))
        counts[large] += 1
        left[large] += 1
        times = min(n // c for n, c in zip(left, counts, strict=True) if c)
        left = [n - c * times for n, c in zip(left, counts, strict=True)]
        found.append(np.array(counts, float))
    return found


def best_mix(sizes: np.ndarray, demand: np.ndarray, capacity: int, cut_price: float = CUT_PRICE, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linear program: columns (class x pattern), how often each is used, and which of them cut.

    A pattern costs one sequence; a column that cuts one piece costs the share of a sequence that it fills and the price of a cut. Prices are
    drawn towards the best ones so far before they are asked for patterns, else they swing for long. The program ends when
    the mix costs at most gap more than a bound that no mix can go below.
    """
    m = len(sizes)
    cut_costs, steady = sizes / capacity + cut_price, sizes / capacity
    columns, inverse, used, costs, pivots = np.eye(m), np.eye(m), demand.astype(float), cut_costs.copy(), 0
    bound, held = float(steady @ demand), 0.8

    def enter(column: np.ndarray, cost: float) -> bool:
        nonlocal used, inverse, pivots
        way = inverse @ column
        steps = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            return False
        used = np.maximum(used - steps[out] * way, 0)
        used[out] = steps[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[:, out], costs[out], pivots = column, cost, pivots + 1
        if pivots % 200 == 0:
            inverse = np.linalg.inv(columns)
            used = np.maximum(inverse @ demand, 0)
        return True

    for pattern in first_patterns(sizes, demand, capacity):
        if costs @ inverse @ pattern > 1 + 1e-9:
            enter(pattern, 1.0)
    for _ in range(4 * m + 100):
        if float(costs @ used) <= bound * (1 + gap):
            break
        prices = costs @ inverse
        worst, dear = int(prices.argmin()), int((prices - cut_costs).argmax())
        if prices[worst] < -1e-9:  # a class that is covered more often than asked: let the surplus in
            moved = enter(-np.eye(m)[worst], 0.0)
        elif prices[dear] > cut_costs[dear] + 1e-9:
            moved = enter(np.eye(m)[dear], float(cut_costs[dear]))
        else:
            asked = held * steady + (1 - held) * prices
            value, found = priced_patterns(sizes, asked, capacity)
            within = asked / max(value, 1)  # the cost of every pattern at least
            if float(within @ demand) > bound:
                bound, steady = float(within @ demand), within
            better = [p for p in found if prices @ p > 1 + 1e-9]
            moved = any([enter(p, 1.0) for p in better if costs @ inverse @ p > 1 + 1e-9])
            if not better and held == 0:
                break  # no pattern is worth more than its sequence: the best mix
            held = 0.8 if better else 0.0 if held < 0.3 else held / 2
            moved = True
        if not moved:
            break
    kept = columns.sum(0) > 0
    cuts = (columns.sum(0) == 1) & (costs < 1)
    return np.rint(columns[:, kept]).astype(int), used[kept], cuts[kept]


@dataclass
class Plan:
    """Sequences so far, and ranges of ranks by class: first rank, copies in each sequence (0: cut), first sequence, first slot."""

    sequences: int = 0
    ranges: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    ranked: dict[int, int] = field(default_factory=dict)

    def add(self, classes: list[int], counts: list[int], times: int) -> None:
        slot = 0
        for c, n in zip(classes, counts, strict=True):
            if n:
                at = self.ranked.get(c, 0)
                self.ranges.setdefault(c, []).append((at, n, self.sequences, slot))
                self.ranked[c], slot = at + n * times, slot + n
        self.sequences += times

    def cut(self, c: int, times: int) -> None:
        at = self.ranked.get(c, 0)
        self.ranges.setdefault(c, []).append((at, 0, -1, 0))
        self.ranked[c] = at + times


def plan(histogram: dict[int, int], capacity: int = SEQUENCE // CLASS, cut_price: float = CUT_PRICE) -> Plan:
    """Patterns for so many pieces of each class; every rank below the histogram's count falls in one range."""
    made, classes = Plan(), sorted(histogram)
    if not classes:
        return made
    sizes, demand = np.array(classes), np.array([histogram[c] for c in classes], float)
    patterns, used, cuts = best_mix(sizes, demand, capacity, cut_price)
    left = demand.astype(np.int64)
    for k in np.argsort(-(used - np.floor(used + 1e-9)), kind="stable"):  # ones that are cut most by rounding get a further chance below
        counts = patterns[:, k]
        most = int((left[counts > 0] // counts[counts > 0]).min())
        times = min(int(np.floor(used[k] + 1e-9)), most)
        if cuts[k] and times:
            made.cut(classes[int(counts.argmax())], times)
        elif times:
            made.add(classes, counts.tolist(), times)
        left -= counts * times
    for k in np.argsort(-(used - np.floor(used + 1e-9)), kind="stable"):
        counts = patterns[:, k]
        if not cuts[k] and (left >= counts).all() and counts @ sizes >= capacity * (1 - cut_price):
            made.add(classes, counts.tolist(), 1)
            left -= counts
    rest = left.tolist()
    while any(rest):
        large = max(k for k, n in enumerate(rest) if n)
        rest[large] -= 1
        counts = fullest(classes, rest, capacity - classes[large])
        counts[large] += 1
        rest[large] += 1
        if sum(c * n for c, n in zip(classes, counts, strict=True)) >= capacity * (1 - cut_price):
            times = min(r // n for r, n in zip(rest, counts, strict=True) if n)
            made.add(classes, counts, times)
            rest = [r - n * times for r, n in zip(rest, counts, strict=True)]
        else:
            made.cut(classes[large], 1)
            rest[large] -= 1
    return made


def _placed(ranked: DataFrame, made: Plan, starts: dict[int, int]) -> DataFrame:
    """ranked with sequence_id and slot; sequence -1 for pieces to cut. The ranges are as many as the patterns have classes."""
    table = sorted((starts[c] + at, n, sequence, slot) for c, own in made.ranges.items() for at, n, sequence, slot in own)
    first, copies, base, slots = (np.array(x, np.int64) for x in zip(*table, strict=True)) if table else [np.zeros(0, np.int64)] * 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            place = f["place"].to_numpy()
            k = np.searchsorted(first, place, side="right") - 1
            each = np.maximum(copies[k], 1)
            within = place - first[k]
            yield f.assign(sequence_id=np.where(copies[k] > 0, base[k] + within // each, -1), slot=slots[k] + within % each)

    kind = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    return ranked.mapInPandas(run, kind)


def pack_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, width: int = CLASS,
                end: int = END, cut_price: float = CUT_PRICE) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence: a power of two, the most tokens of a sequence, which is padded to it unless it holds a power of two. width: tokens that classes of
    lengths are rounded up to. Null and empty texts are the end id alone; long texts are cut whole sequence by whole sequence. Null
    ids stay; repeated rows are packed each; rows of a class rank by id, start and crc32, so the same rows give the same sequences at any
    partitioning. An empty table gives an empty result; other columns are left out.
    """
    pieces = durable(pieces_of(docs, tokenizer, id_col, text_col, sequence, end))
    kind = F.ceil(F.col("length") / width).alias("class")
    ranked = durable(numbered(pieces.select("*", kind), "class", "id", "start", "ids_crc32", "doc_tokens"))
    histogram = {r["class"]: r["count"] for r in ranked.groupBy("class").count().collect()}  # at most sequence / width rows
    made = plan(histogram, sequence // width, cut_price)
    starts, at = {}, 0
    for c in sorted(histogram):
        starts[c], at = at, at + histogram[c]
    placed = durable(_placed(ranked, made, starts))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(columns)
    bits = F.expr(f"filter(sequence({sequence.bit_length() - 2}, 0, -1), b -> (shiftright(length, b) & 1) = 1)")
    parts = placed.where("sequence_id < 0").select("id", "start", "length", "doc_tokens", F.posexplode(F.arrays_zip(bits.alias("bit"), F.col("parts").alias("crc"))).alias("nth", "part"))
    size = F.expr("shiftleft(1L, part.bit)")
    above = F.expr("length - (length & (shiftleft(1L, part.bit + 1) - 1))")  # the larger parts stand before
    parts = parts.select("id", (F.col("start") + above).alias("start"), size.alias("length"), F.col("part.crc").alias("ids_crc32"), "doc_tokens", (-size).alias("shortest"))
    cut_up = durable(numbered(parts, "shortest", "id", "start", "ids_crc32", "doc_tokens"))
    sizes = sorted(((r["length"], r["count"]) for r in cut_up.groupBy("length").count().collect()), reverse=True)
    laid, numbers, tokens = F.lit(0).cast("long"), 0, 0
    for length, count in sizes:  # parts from the longest down lie end to end, so each starts at a multiple of itself
        laid = F.when(F.col("length") == length, F.lit(tokens) + (F.col("place") - numbers) * length).otherwise(laid)
        numbers, tokens = numbers + count, tokens + length * count
    full, rest, extra = tokens // sequence, tokens % sequence, []
    sequence_id, offset = F.floor(F.col("laid") / sequence), F.col("laid") % sequence
    for bit in reversed(range(sequence.bit_length())):  # the last ones are powers of two, so they need no padding
        if rest >> bit & 1:
            extra.append((full * sequence + (rest >> bit + 1 << bit + 1), 1 << bit))
    for k, (begin, _) in enumerate(extra):
        sequence_id = F.when(F.col("laid") >= begin, F.lit(full + k)).otherwise(sequence_id)
        offset = F.when(F.col("laid") >= begin, F.col("laid") - begin).otherwise(offset)
    cut_up = cut_up.withColumn("laid", laid).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (sequence_id + made.sequences).cast("long").alias("sequence_id"), offset.cast("long").alias("offset")
    )
    return whole.unionByName(cut_up).withColumnRenamed("id", id_col)
