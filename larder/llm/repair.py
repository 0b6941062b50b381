"""Repair of conversation structure: the cheapest edits that bring roles into order, the least of equal ones by their letters.

Roles have to read system at most once, then user and assistant in turn, which is an automaton of four states; a node is a row with
the state before it. A cost programme runs backwards over the rows. Of the arcs that keep the cost least, a node keeps
the one of the least letter, and nodes are ranked by the first letter, the first two, four, eight of what they lead to (prefix
doubling), each round joining the rank of a node and that of its pointer. The pointers of the rounds read any letter of a path at once.

Rows are numbered in order and solved in blocks of bounded size. A conversation that crosses blocks gives, for each of its segments,
costs and ranks between all states at both ends; these few numbers settle which states it passes, and blocks are then solved alike.
So a conversation of any size spreads over many tasks. Its hash is a chain through its texts: one task reads them in
order as a stream and keeps the hash state and the letters alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import durable, numbered, small_or_shuffled

#: Costs of the edits, and of a truncated row that stays; rows of a block.
DELETE, INSERT, REROLE, TRUNCATED, BLOCK = 2, 5, 1, 5, 1024
_LETTERS = "-DIKR"  # in the order of their ranks; the first ends a path
_INITIALS = {"s": 1, "u": 2, "a": 3}
_ROLES = {2: "user", 3: "assistant"}
_START, _USER, _ASSISTANT = 0, 2, 3  # states: start, after system, after user, after assistant
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the state that an inserted or changed role leads to
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])  # state x initial -> state
_ENDING = ["", "ua", "a", ""]  # what each state lacks at the end
_END_COSTS = np.array([INSERT * len(e) for e in _ENDING])
_NEVER = 1 << 40
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


class Paths:
    """Least paths of the segments of a block: from every state at the start to every state at the end.

    Nodes are (layer, state, target state at the segment's end); a segment of n rows has n + 1 layers.
    """

    def __init__(self, initials: np.ndarray, dropped: np.ndarray, truncated: np.ndarray, lengths: np.ndarray):
        self.first = np.cumsum(lengths + 1) - lengths - 1  # first layer of each segment
        ends = self.first + lengths
        layers = int(lengths.sum() + len(lengths))
        is_row = np.ones(layers, bool)
        is_row[ends] = False
        self.row = np.cumsum(is_row) - 1
        initial, drop, cut_off = np.zeros(layers, np.int64), np.zeros(layers, bool), np.zeros(layers, np.int64)
        initial[is_row], drop[is_row], cut_off[is_row] = initials, dropped, truncated
        kept_to = _KEEP[:, initial].T  # layer x state
        keep_cost = np.where(drop[:, None] | (kept_to < 0), _NEVER, TRUNCATED * cut_off[:, None])
        role_cost = np.where(drop, _NEVER, REROLE + TRUNCATED * cut_off)[:, None, None]
        self.cost = np.full((layers, 4, 4), _NEVER)
        self.cost[ends] = np.where(np.eye(4, dtype=bool), 0, _NEVER)
        by_length = np.argsort(-lengths, kind="stable")
        for step in range(int(lengths.max(initial=0))):
            now = ends[by_length[: int((lengths > step).sum())]] - 1 - step
            after = self.cost[now + 1]
            base = np.minimum(after + DELETE, after[:, _NEXT] + role_cost[now])
            kept = np.take_along_axis(after, np.maximum(kept_to[now], 0)[:, :, None], 1) + keep_cost[now][:, :, None]
            base = least = np.minimum(base, kept)
            for _ in range(3):  # more inserts in a row lead back to a state passed before
                least = np.minimum(base, INSERT + least[:, _NEXT])
            self.cost[now] = np.minimum(least, _NEVER)
        self._arcs(is_row, kept_to, keep_cost, role_cost)
        self._rank(2 * int(lengths.max(initial=0)) + 4)

    def _arcs(self, is_row, kept_to, keep_cost, role_cost) -> None:
        """The least letter of a tight arc of every node, and where it leads."""
        layer, state, target = np.indices(self.cost.shape)
        after = np.minimum(layer + 1, len(self.cost) - 1)
        same, down = np.full(self.cost.shape, _NEVER), np.broadcast_to(_NEXT[None, :, None], self.cost.shape)
        keep_state = np.broadcast_to(np.maximum(kept_to, 0)[:, :, None], self.cost.shape)
        ways = [(after, state, same * 0 + DELETE), (layer, down, same * 0 + INSERT),
                (after, keep_state, np.broadcast_to(keep_cost[:, :, None], same.shape)), (after, down, np.broadcast_to(role_cost, same.shape))]
        self.letter = np.zeros(self.cost.shape, np.int64)
        to = np.arange(self.cost.size).reshape(self.cost.shape)
        open_nodes = is_row[:, None, None] & (self.cost < _NEVER)
        for k, (next_layer, next_state, price) in enumerate(ways, 1):
            tight = open_nodes & (self.letter == 0) & (self.cost[next_layer, next_state, target] + price == self.cost)
            self.letter[tight] = k
            to[tight] = ((next_layer * 4 + next_state) * 4 + target)[tight]
        self.letter, to = self.letter.ravel(), to.ravel()
        self.pointers = [to]

    def _rank(self, longest: int) -> None:
        rank, steps = self.letter, (self.letter > 0).astype(np.int64)
        while 1 << len(self.pointers) - 1 < longest and steps[self.pointers[-1]].any():
            to = self.pointers[-1]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[to], return_inverse=True)
            steps = steps + steps[to]
            self.pointers.append(to[to])
        self.rank, self.steps = rank, steps

    def between(self, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs and ranks of a segment, state at its start x state at its end."""
        at = self.first[segment]
        return self.cost[at], self.rank[at * 16:at * 16 + 16].reshape(4, 4)

    def read(self, segment: int, state: int, target: int) -> list[tuple[int, str, int]]:
        """row (within the block), letter and state before it, of every edit on the least path."""
        start = (int(self.first[segment]) * 4 + state) * 4 + target
        nth = np.arange(self.steps[start])
        nodes = np.full(len(nth), start)
        for k, to in enumerate(self.pointers):
            nodes = np.where(nth >> k & 1, to[nodes], nodes)
        return [(int(self.row[n // 16]), _LETTERS[self.letter[n]], n // 4 % 4) for n in nodes.tolist()]


def through(costs: list[np.ndarray], ranks: list[np.ndarray]) -> list[tuple[int, int]]:
    """States at the start and the end of each segment on a conversation's least path."""
    to_go = [_END_COSTS]
    for cost in reversed(costs):
        to_go.append((cost + to_go[-1][None]).min(1))
    state, passed = _START, []
    for cost, rank, after in zip(costs, ranks, reversed(to_go[:-1]), strict=True):
        total = cost[state] + after
        target = int(min(np.flatnonzero(total == total.min()), key=lambda t: rank[state][t]))
        passed.append((state, target))
        state = target
    return passed


def _paths(rows: pd.DataFrame) -> tuple[pd.DataFrame, Paths, np.ndarray]:
    rows = rows.sort_values("place", kind="stable")
    starts = np.flatnonzero(rows["opens"].to_numpy() != np.concatenate([[-1], rows["opens"].to_numpy()[:-1]]))
    lengths = np.diff(np.append(starts, len(rows)))
    fault = rows["fault"].to_numpy()
    return rows, Paths(rows["initial"].to_numpy(), (fault == 1) | (fault == 2), fault == 3, lengths), starts


def _segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs and ranks of each segment of a block."""
    rows, paths, starts = _paths(rows)
    found = [paths.between(k) for k in range(len(starts))]
    return pd.DataFrame({"opens": rows["opens"].to_numpy()[starts], "block": rows["block"].iloc[0],
                         "costs": [c.ravel().tolist() for c, _ in found], "ranks": [r.ravel().tolist() for _, r in found]})


def _settle(segments: pd.DataFrame) -> pd.DataFrame:
    """States that a conversation passes between its segments."""
    segments = segments.sort_values("block")
    square = lambda c: [np.array(x).reshape(4, 4) for x in segments[c]]
    passed = through(square("costs"), square("ranks"))
    last = np.arange(len(segments)) == len(segments) - 1
    return pd.DataFrame({"opens": segments["opens"], "block": segments["block"], "state": [s for s, _ in passed], "target": [t for _, t in passed], "last": last})


def _solve(rows: pd.DataFrame, settled: pd.DataFrame) -> pd.DataFrame:
    """The edit of every row of a block, the roles inserted before it and, at a conversation's end, after it."""
    rows, paths, starts = _paths(rows)
    known = {o: (s, t, last) for o, s, t, last in zip(settled["opens"], settled["state"], settled["target"], settled["last"], strict=True)}
    inserted, edits, roles, after = [""] * len(rows), [""] * len(rows), [None] * len(rows), [""] * len(rows)
    for k, opens in enumerate(rows["opens"].to_numpy()[starts].tolist()):
        cost, rank = paths.between(k)
        state, target, last = known.get(opens) or (*through([cost], [rank])[0], True)
        end = (starts[k + 1] if k + 1 < len(starts) else len(rows)) - 1
        for row, letter, before in paths.read(k, state, target):
            if letter == "I":
                inserted[row] += "sua"[_NEXT[before] - 1]
            else:
                edits[row] = letter
                roles[row] = _ROLES[int(_NEXT[before])] if letter == "R" else None
        after[end] = _ENDING[target] if last else ""
    return pd.DataFrame({"place": rows["place"], "inserted": inserted, "edit": edits, "new_role": roles, "after": after})


def damage(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and copies (1 or 2) of the rows that stay, by the crc32 of `conv:turn` modulo 20."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled(text_col), ".!?", "")).otherwise(filled(text_col))
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(filled(role_col)).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def _key(rows: DataFrame) -> DataFrame:
    """Rows with what orders them after conv, turn and role: the beginning of the text and a hash of it."""
    return rows.withColumns({"begins": F.substring("text", 1, 32), "text_key": F.sha2("text", 256)})


_ORDER = ["conv", "turn", "role", "begins", "text_key"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each conversation from its rows in order; a text comes before the rows that have it."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    current: dict | None = None
    kind, done = None, []

    def close() -> None:
        if current is not None:
            c = current
            gaps = c["max"] - c["min"] + 1 - c["turns"] if c["turns"] else 0
            done.append((c["conv"], gaps, *c["faults"], c["illegal"], c["cost"], c["audit"].decode(), c["hash"].hexdigest()))

    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = [batch.column(n) for n in ("conv", "turn", "role", "text", "fault", "inserted", "edit", "new_role", "after")]
        narrow = [c.to_pylist() if i != 3 else None for i, c in enumerate(columns)]
        for i in range(batch.num_rows):
            conv, turn, role, _, fault, inserted, edit, new_role, after = (None if c is None else c[i] for c in narrow)
            if current is None or conv != current["conv"]:
                close()
                current = {"conv": conv, "turns": 0, "min": 0, "max": None, "faults": [0, 0, 0], "illegal": 0, "cost": 0,
                           "audit": bytearray(), "hash": sha256(), "lines": 0, "role": None, "text": b""}
            c = current
            if edit is None:
                c["text"] = columns[3][i].as_buffer()
                continue
            if turn is not None and (not c["turns"] or turn != c["max"]):
                c["min"], c["max"], c["turns"] = (c["min"] if c["turns"] else turn), turn, c["turns"] + 1
            if fault:
                c["faults"][fault - 1] += 1
            c["illegal"] += c["role"] is not None and c["role"] + role[:1] not in ("su", "ua", "au")
            c["role"] = role[:1]
            lines = [(_ROLES[_INITIALS[r]], b"") for r in inserted]
            lines += [] if edit == "D" else [(new_role or role, c["text"])]
            lines += [(_ROLES[_INITIALS[r]], b"") for r in after]
            c["audit"] += ("I" * len(inserted) + edit + "I" * len(after)).encode()
            c["cost"] += INSERT * (len(inserted) + len(after)) + {"D": DELETE, "K": 0, "R": REROLE}[edit] + TRUNCATED * (fault == 3 and edit != "D")
            for name, text in lines:
                c["hash"].update(("\n" * (c["lines"] > 0) + name + ":").encode())
                c["hash"].update(text)
                c["lines"] += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind if n == "conv" else None) for n, x in zip(names, zip(*done, strict=True), strict=True)], names=names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind if n == "conv" else None) for n, x in zip(names, zip(*done, strict=True), strict=True)], names=names)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block_rows: int = BLOCK) -> DataFrame:
    """One row per id of conversations: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles, texts and parts of the damage key read as one space; null ids are one conversation; null turns come first and count for no gap.
    Rows of equal turn follow by role, the first 32 characters of the text and its hash; repeated rows stay and are duplicates. A
    conversation without rows after the damage has zeros, an empty audit and the hash of nothing. An empty table gives an empty result;
    other columns are left out. block_rows: the most rows that are solved at once.
    """
    rows = damage(conversations, conv_col, turn_col, role_col, text_col)
    trimmed = F.rtrim("text", F.lit(_BLANKS))
    narrow = _key(rows).select(
        *_ORDER, (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    )
    placed = durable(numbered(durable(narrow), *_ORDER, "copy"))
    extents = durable(placed.groupBy("conv").agg(F.min("place").alias("opens"), F.max("place").alias("closes")))
    repeats = small_or_shuffled(
        placed.where("NOT blank").groupBy("conv", "role", "text_key").agg(F.min("place").alias("earliest"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("conv").alias("d_conv"), F.col("role").alias("d_role"), F.col("text_key").alias("d_key"), "earliest")
    )
    seen = placed.join(repeats, _same(F.col("conv"), F.col("d_conv")) & (F.col("role") == F.col("d_role")) & (F.col("text_key") == F.col("d_key")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("place") > F.col("earliest"), 2).when(F.col("cut_off"), 3).otherwise(0)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == r, n) for r, n in _INITIALS.items()], F.lit(0))
    opened = small_or_shuffled(extents.select(F.col("conv").alias("o_conv"), "opens", (F.floor(F.col("opens") / block_rows) != F.floor(F.col("closes") / block_rows)).alias("crosses")))
    known = durable(
        seen.join(opened, _same(F.col("conv"), F.col("o_conv")))
        .select(*_ORDER, "place", "opens", "crosses", initial.alias("initial"), fault.alias("fault"), F.floor(F.col("place") / block_rows).alias("block"))
    )
    solvable = known.select("block", "place", "opens", "initial", "fault")
    crossing = known.where("crosses").select("block", "place", "opens", "initial", "fault")
    segments = durable(crossing.groupBy("block").applyInPandas(_segments, "opens long, block long, costs array<long>, ranks array<long>"))
    settled = durable(segments.groupBy("opens").applyInPandas(_settle, "opens long, block long, state int, target int, last boolean"))
    edits = solvable.groupBy("block").cogroup(settled.groupBy("block")).applyInPandas(_solve, "place long, inserted string, edit string, new_role string, after string")
    decided = known.join(durable(edits), "place").select(*_ORDER, "place", "fault", "inserted", "edit", "new_role", "after", F.lit(None).cast("binary").alias("text"))
    texts = _key(rows).select(*_ORDER, F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (("fault", "int"), ("inserted", "string"), ("edit", "string"), ("new_role", "string"), ("after", "string"))], F.col("text").cast("binary").alias("text"))
    kind = conversations.schema[conv_col].dataType.simpleString()
    ordered = decided.unionByName(texts).repartition("conv").sortWithinPartitions(*_ORDER, "place")
    totals = ordered.select("conv", "turn", "role", "text", "fault", "inserted", "edit", "new_role", "after").mapInArrow(
        _stream, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    every = conversations.select(F.col(conv_col).alias("every")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(totals, _same(F.col("every"), F.col("conv")), "left").select(
        F.col("every").alias(conv_col), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
