"""Manifest against a plain recomputation of every tree, tampered leaf by tampered leaf."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from larder.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root, and for each digest its siblings by level as (left, right)."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(places):
            run = at // 16 * 16
            paths[i].append((digests[run:at], digests[at + 1:run + 16]))
        digests = [h(*digests[i:i + 16]) for i in range(0, len(digests), 16)]
        places = [p // 16 for p in places]
    return digests[0], paths


def slow_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    by_source = defaultdict(list)
    for r in rows:
        leaf = h(*map(field, r))
        text = r[4] if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        bad = h(*map(field, r[:4]), field(text)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf, bad, r[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for x, path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            whole, folded = path + top, x[3]
            for left, right in whole:
                folded = h(*left, folded, *right)
            proof = h(*(d for left, right in whole for d in left + right))
            out.append((x[4], x[2], trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"only": 1}, {"only": 16}, {"only": 17}, {"a": 257, "b": 1}, {None: 3, "": 2, "Z": 1, "a": 256, "é": 4097}, {f"s{i}": i % 3 + 1 for i in range(300)}])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(n * 7 + i, s, "en", n, f"Text {n} OF {s}") for i, (s, size) in enumerate(sizes.items()) for n in range(size)]
    assert rows_of(spark.createDataFrame(rows[::-1], KIND).repartition(3)) == slow_manifest(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", "en", 3, "ABC"), (None, "s", "en", 3, "ABC"), (1, "s", None, None, ""), (2, "", "", 0, None)]
    rows += [(5, "s", "en", 9, "same ROW")] * 40 + [(5, "s", "en", 9, "other ROW"), (9, "t", "de", 1, "Ä B" * 100_000), (-3, "t", "de", 1, "ÀÉ lower")]
    rows += [(i, "u", "en", 9, text) for i in range(20, 40) for text in ("TAMPERED", "as it was", None, "")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, KIND)
    clashes = ["id", "leaf", "tree", "pos", "digest", "levels", "place", "range", "same", "chunk", "tampered", "n", "at", "f0", "path", "root", "named"]
    got = rows_of(df.withColumns({c: F.lit("clash") for c in clashes}))
    assert got == slow_manifest(rows) and any(not r[-1] for r in got)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_slots_resume_the_hash():
    digests = [h(str(i)) for i in range(16)]
    whole, slots = merkle.parent(digests)
    assert whole == h(*digests)
    for i, slot in enumerate(slots):
        assert slot.fold(h("new")) == h(*digests[:i], h("new"), *digests[i + 1:]) and slot.fold(digests[i]) == whole
