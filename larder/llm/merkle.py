"""Merkle manifest of a table: SHA-256 trees with runs of sixteen, one for every source and one over the sources.

Parents keep a copy of their hash state before each child slot. To fold a replaced child, the state of its slot is resumed with
the replacement and the siblings to its right alone; nothing to its left is hashed again. Rows are dealt by ranges of
(source, id), so a hot source spreads over many tasks, and trees are built in chunks of 256 nodes (two levels) of a source.
Chunk digests are the nodes of the next round. On the way down every chunk gets the siblings of the levels above it
once, so nothing grows with the number of rows of a source but the number of chunks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import durable, numbered, small_or_shuffled

#: Nodes of a run; levels that one chunk spans; every how many-th id (by crc32) the check tampers with.
FANOUT, CHUNK_LEVELS, TAMPERED = 16, 2, 5
_SPAN = FANOUT**CHUNK_LEVELS
_FOLD = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_NODES = "tree long, levels int, pos long, digest string"
_PATHS = "tree long, pos long, path array<string>, subroot string"


class Slot:
    """A child's place in its parent: the hash state before it, and the digests on both sides as hex text."""

    def __init__(self, before, left: bytes, right: bytes):
        self.before, self.left, self.right = before, left, right

    def fold(self, digest: str) -> str:
        """The parent's digest with this child replaced."""
        state = self.before.copy()
        state.update(digest.encode())
        state.update(self.right)
        return state.hexdigest()


def parent(children: list[str]) -> tuple[str, list[Slot]]:
    """Digest of a run, and the slot of every child."""
    joined, state, slots = "".join(children).encode(), sha256(), []
    width = len(joined) // len(children)
    for i, child in enumerate(children):
        slots.append(Slot(state.copy(), joined[: i * width], joined[(i + 1) * width:]))
        state.update(child.encode())
    return state.hexdigest(), slots


def subtree(digests: list[str], levels: int) -> tuple[list[str], list[list[Slot]]]:
    """Digests left after so many levels, and the slots of each level's nodes."""
    above = []
    for _ in range(levels):
        runs = [parent(digests[i:i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        above.append([slot for _, slots in runs for slot in slots])
        digests = [digest for digest, _ in runs]
    return digests, above


def _levels(n: Column) -> Column:
    """Rounds until one node is left: the hexadecimal digits of n - 1; none for a lone node."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0).cast("int")


def leaves(docs: DataFrame, id_col: str, source_col: str, fields: list[str], text_col: str) -> DataFrame:
    """id, source, leaf, tampered (the leaf with the text in lower case where the id is chosen, else null) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, tampered = [], []
            for row in range(batch.num_rows):
                state, chosen = sha256(), None
                number, *parts = [batch.column(i)[row].as_buffer() for i in range(2, batch.num_columns)]
                for part in parts[:-1]:
                    state.update(b"-" if part is None else b"%d:" % len(part))
                    state.update(part or b"")
                text = parts[-1]
                state.update(b"-" if text is None else b"%d:" % len(text))
                if number is not None and crc32(number) % TAMPERED == 0:
                    chosen = state.copy()
                    chosen.update(text.to_pybytes().translate(_FOLD) if text is not None else b"")
                state.update(text or b"")
                digests.append(state.hexdigest())
                tampered.append(chosen and chosen.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(tampered, pa.string())], names=["id", "source", "leaf", "tampered"]
            )

    as_bytes = [F.col(c).cast("string").cast("binary").alias(f"f{i}") for i, c in enumerate([id_col, *[f for f in fields if f != text_col], text_col])]
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *as_bytes)
    return narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, source string, leaf string, tampered string")


def _rise(group: pd.DataFrame) -> pd.DataFrame:
    nodes = group.sort_values("pos")
    tree, levels, pos = (int(nodes[c].iloc[0]) for c in ("tree", "levels", "pos"))
    (digest,), _ = subtree(nodes["digest"].tolist(), min(levels, CHUNK_LEVELS))
    return pd.DataFrame({"tree": [tree], "levels": [max(0, levels - CHUNK_LEVELS)], "pos": [pos // _SPAN], "digest": [digest]})


def _chunk() -> Column:
    return F.shiftright("pos", 4 * CHUNK_LEVELS).alias("chunk")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The frames of nodes that were joined to chunks, lowest first, and the node that is left of each tree."""
    rounds = []
    while True:
        rounds.append(nodes)
        nodes = durable(nodes.select("tree", "levels", "pos", "digest").groupBy("tree", _chunk()).applyInPandas(_rise, _NODES))
        if nodes.where("levels > 0").isEmpty():
            return rounds, nodes


def _paths(nodes: pd.DataFrame, above: pd.DataFrame) -> tuple[pd.DataFrame, list[list[Slot]], list[Slot]]:
    """Nodes of a chunk in order, their slots by level, and the slots above the chunk."""
    nodes = nodes.sort_values("pos")
    _, slots = subtree(nodes["digest"].tolist(), min(int(nodes["levels"].iloc[0]), CHUNK_LEVELS))
    path = [x.encode() for x in above["path"].iloc[0]]
    return nodes, slots, [Slot(sha256(left), left, right) for left, right in zip(path[::2], path[1::2], strict=True)]


def _down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Each node's siblings of all levels, as text left and right of it."""
    nodes, slots, upper = _paths(nodes, above)
    paths = []
    for i in range(len(nodes)):
        own = [level[i // FANOUT**k] for k, level in enumerate(slots)] + upper
        paths.append([side.decode() for slot in own for side in (slot.left, slot.right)])
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": paths, "subroot": above["subroot"].iloc[0]})


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, pos, path, subroot of the nodes of the lowest frame; above: the same of each tree's last node."""
    for nodes in reversed(rounds):
        left = nodes.select("tree", "levels", "pos", "digest").groupBy("tree", _chunk())
        above = durable(left.cogroup(above.groupBy("tree", F.col("pos").alias("chunk"))).applyInPandas(_down, _PATHS))
    return above


def _prove(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The proof and the folded root of every leaf of a chunk."""
    nodes, slots, upper = _paths(nodes, above)
    folded: dict[tuple, str] = {}  # above its run, one path serves all leaves that fold to the same digest
    proofs, roots = [], []
    for i, (digest, tampered) in enumerate(zip(nodes["digest"], nodes["tampered"], strict=True)):
        own = [level[i // FANOUT**k] for k, level in enumerate(slots)] + upper
        proof, value = sha256(), tampered or digest
        for slot in own:
            proof.update(slot.left)
            proof.update(slot.right)
        proofs.append(proof.hexdigest())
        if own:
            value = own[0].fold(value)
            key = (i // FANOUT, value)
            if key not in folded:
                for slot in own[1:]:
                    value = slot.fold(value)
                folded[key] = value
            value = folded[key]
        roots.append(value)
    return pd.DataFrame({"id": nodes["id"], "leaf": nodes["digest"], "subroot": above["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": roots})


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, leaf, subroot (its source's), root, proof_sha256, folded_root, verified (folded_root is root).

    fields are hashed in the given order, text_col last; a null is `-`. Rows with a null source form a tree of their own, the first one. Within
    a source rows ascend by id, null ids first and never tampered with; rows of equal id follow their leaf, and repeated rows are
    leaves each. Null and empty texts are leaves like any other, long ones are hashed whole. An empty table gives an empty result;
    other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    hashed = durable(leaves(docs, id_col, source_col, list(fields), text_col))
    placed = durable(numbered(hashed, "source", "id", "leaf"))
    sources = durable(placed.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("n")))
    of_source = small_or_shuffled(sources.select(F.col("source").alias("named"), "tree", "n"))
    rows = placed.join(of_source, F.col("source").eqNullSafe(F.col("named"))).select(
        "tree", _levels(F.col("n")).alias("levels"), (F.col("place") - F.col("tree")).alias("pos"), F.col("leaf").alias("digest"), "tampered", "id"
    )
    rounds, subroots = _climb(durable(rows))
    n_sources = sources.count()
    tops = durable(numbered(subroots.select("tree", "digest"), "tree").withColumnRenamed("tree", "of"))
    top_rounds, top = _climb(tops.select("of", F.lit(0).cast("long").alias("tree"), _levels(F.lit(n_sources)).alias("levels"), F.col("place").alias("pos"), "digest"))
    root = (top.first() or {"digest": ""})["digest"]
    start = top.select("tree", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    tops_down = _descend(top_rounds, start).select("pos", "path")
    of_trees = tops.join(tops_down.withColumnRenamed("pos", "place"), "place").select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot")
    )
    above = _descend(rounds[1:], durable(of_trees))
    proved = rounds[0].groupBy("tree", _chunk()).cogroup(above.groupBy("tree", F.col("pos").alias("chunk"))).applyInPandas(
        _prove, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return proved.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def oracle(levels: int = 6) -> str:
    """SQL for tables of up to 16 ** levels rows a source, and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    shift = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda c, b: {shift}), 4294967295)"
    steps = []

    def climb(name: str, key: str) -> None:
        """From the nodes {name}0 (key, pos, h) to {name}{levels}; {name}side has each node's siblings by level."""
        for k in range(levels):
            lone = f"(SELECT {key} AS lone_key, count(*) = 1 AS lone FROM {name}{k} GROUP BY 1)"
            steps.append(f"""{name}{k + 1} AS (SELECT {key}, pos // {FANOUT} AS pos, CASE WHEN any_value(lone) THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {name}{k} JOIN {lone} ON {key} = lone_key GROUP BY {key}, pos // {FANOUT})""")
            steps.append(f"""{name}side{k} AS (SELECT {key}, pos, lone, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} JOIN {lone} ON {key} = lone_key WINDOW w AS (PARTITION BY {key}, pos // {FANOUT} ORDER BY pos))""")

    steps.append(f"""hashed AS (SELECT doc_id, source, sha256({head} || {field("text")}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % {TAMPERED} = 0 THEN sha256({head} || {field(lowered)}) END AS tampered FROM documents)""")
    steps.append("""leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed)""")
    steps.append("n0 AS (SELECT tree, place AS pos, leaf AS h FROM leaves)")
    climb("n", "tree")
    steps.append(f"t0 AS (SELECT 0 AS top, tree - 1 AS pos, h FROM n{levels})")
    climb("t", "top")
    steps.append("f0 AS (SELECT doc_id, leaf, tree, place, coalesce(tampered, leaf) AS folded, '' AS proof FROM leaves)")
    for k in range(2 * levels):
        name, level, at = ("n", k, f"s.tree = f.tree AND s.pos = f.place // {FANOUT**k}") if k < levels else ("t", k - levels, f"s.pos = (f.tree - 1) // {FANOUT ** (k - levels)}")
        steps.append(f"""f{k + 1} AS (SELECT doc_id, leaf, f.tree, place, CASE WHEN lone THEN folded ELSE sha256(before || folded || after) END AS folded,
  proof || before || after AS proof FROM f{k} f JOIN {name}side{level} s ON {at})""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, n.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM f{2 * levels} f JOIN n{levels} n ON n.tree = f.tree CROSS JOIN t{levels} t"""
