"""Fingerprints, components and kept rows against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from larder.llm import neardup
from larder.llm.components import components


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, links):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é  \t\n\x0b\x1c\x85.", max_size=60))
def test_fingerprint(text):
    assert neardup.fingerprint(neardup.shingle_hashes(neardup.words_of(text))) == slow_print(text)


def test_long_text():
    text = " ".join(str(i * i % 977) for i in range(100_000))
    assert neardup.fingerprint(neardup.shingle_hashes(neardup.words_of(text))) == slow_print(text)


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(60 - i, 59 - i) for i in range(0, 60, 2)], [(0, i) for i in range(50)], [(99, i) for i in range(50)],
    [((i * 37) % 80, (i * 61 + 7) % 80) for i in range(70)], [(5, 5), (3, 4), (4, 3)],
])
def test_components(spark, links):
    want = {n: c for n, c in slow_components({x for e in links for x in e}, links).items() if n != c}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_links_connect_all_near_fingerprints(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = set(centres.tolist())
    for c in centres.tolist()[:20]:  # dense groups around some, chains from others
        for _ in range(12):
            prints.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    for c in centres.tolist()[20:]:
        for _ in range(6):
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(3, 6), replace=False))
            prints.add(c)
    values = np.array(sorted(prints), np.uint64)
    near = [(int(a), int(values[j])) for i, a in enumerate(values) for j in np.flatnonzero(np.bitwise_count(a ^ values[i + 1:]) <= 4) + i + 1]
    signed = lambda x: x - 2**64 if x >> 63 else x
    got = neardup.links(spark.createDataFrame([(signed(int(v)),) for v in values], "fingerprint long")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in got)
    nodes = {signed(int(v)) for v in values}
    assert slow_components(nodes, [(r.a, r.b) for r in got]) == slow_components(nodes, [(signed(a), signed(b)) for a, b in near])


def brute(rows):
    prints = [slow_print(t) for _, t in rows]
    nodes = range(len(rows))
    return prints, slow_components(nodes, [(i, j) for i in nodes for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])


def test_table_equals_brute_force(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints, groups = brute(rows)
    lowest = {}
    for i, c in groups.items():
        lowest[c] = min(lowest.get(c, rows[i][0]), rows[i][0])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == {rows[i][0]: (f"{prints[i]:016x}", lowest[groups[i]]) for i in groups}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(lowest.values())


def test_odd_rows(make_docs):
    long = "one two three four five six seven eight nine ten " * 300
    rows = [(5, None), (4, ""), (None, " \n"), (7, "a b"), (7, "a b"), (None, "q r s"), (None, "q r s"), (9, long), (2, long.upper()), (9, "other words here now")]
    docs = make_docs(rows)
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    assert [g for g in got if g[1] == "0" * 16] == [(0, "0" * 16, 4), (4, "0" * 16, 4), (5, "0" * 16, 4)]
    assert {c for d, f, c in got if d == 0 and f != "0" * 16} == {None}
    kept = sorted((r.doc_id or 0, r.text) for r in neardup.keep_one(docs).collect())
    assert kept == sorted([(4, ""), (7, "a b"), (0, "q r s"), (2, long.upper()), (9, "other words here now")])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_clusters_of_odd_rows(make_docs):
    rows = [(5, None), (None, " "), (7, "a b"), (7, "A  b"), (None, "q r s"), (None, "q r s"), (8, "other words here")]
    docs = make_docs(rows)
    got = neardup.clusters(docs, words=True, source_key=F.xxhash64("source")).collect()
    assert sorted(((r.id or 0), r.n_words) for r in got) == [(0, 0), (0, 3), (0, 3), (5, 0), (7, 2), (7, 2), (8, 3)]
    by = {(r.id, r.n_words): (r.cluster, r.words_key) for r in got}
    assert len({r.cluster for r in got}) == len(set(by.values())) == 4 and {r.source_key for r in got} != {None}
    assert neardup.clusters(docs.limit(0)).count() == 0
