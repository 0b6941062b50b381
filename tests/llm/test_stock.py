"""Token packing: ids against the tokenizer itself, the plan against known optima, every piece against the texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import stock

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    IDS = stock.Ids(f.read())


def encoded(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aAeEHhİıſḴ'sStT.,!1²½̱́̇ \t\n\x0b\x1c\x85\xa0 <|>endofx", max_size=60))
def test_ids_by_words(text):
    assert IDS.of(text.encode()) == encoded(text).tobytes()


@pytest.mark.parametrize("text", ["", " \n", "<|endoftext|>", "a<|startoftext|> b", "<|ENDOFTEXT|>", "H̱ ẖ İ don't DON'T we'll", "word " * 30_000])
def test_ids_of_odd_texts(text):
    assert IDS.of(text.encode()) == encoded(text).tobytes()


def test_full_table_of_words(monkeypatch):
    monkeypatch.setattr(stock, "WORDS", 5)
    with open(PATH, encoding="utf-8") as f:
        small = stock.Ids(f.read())
    for text in ("One two three four", "five six Seven", "one two eight nine ten eleven twelve", "TWO"):
        assert small.of(text.encode()) == encoded(text).tobytes()


def cost(sizes, demand, capacity):
    patterns, used, cuts = stock.best_mix(np.array(sizes), np.array(demand, float), capacity, cut_price=10.0, gap=0)
    assert (patterns @ used >= np.array(demand) - 1e-6).all() and (np.array(sizes) @ patterns[:, ~cuts] <= capacity).all()
    return used[~cuts].sum() + sum(used[cuts]) * 10


def test_known_optima():
    assert cost([3, 5, 7], [30, 20, 10], 10) == pytest.approx(10 + 10 + 20 / 3)  # 7+3, 5+5, and 3+3+3 for the rest
    assert cost([51], [9], 100) == pytest.approx(9)
    assert cost([2, 3], [6, 4], 6) == pytest.approx(4)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 60), min_size=1, max_size=6))
def test_mix_is_the_best(histogram):
    """Against the dual bound: the prices of the best mix let no pattern be worth more than its sequence."""
    sizes, demand = np.array(sorted(histogram)), np.array([histogram[c] for c in sorted(histogram)], float)
    got = cost(sizes, demand, 12)
    every = [()]
    for s in sizes:  # all patterns, by brute force
        every = [(*p, n) for p in every for n in range(12 // s + 1) if sum(a * b for a, b in zip(p, sizes, strict=False)) + n * s <= 12]
    a = np.array(every, float)
    best = 0.0
    for prices in np.random.default_rng(0).dirichlet(np.ones(len(sizes)), 200):
        best = max(best, prices @ demand / (a @ prices).max())
    assert got >= best - 1e-6 and got >= sizes @ demand / 12 - 1e-6
    for seen in ({"cut_price": 1 / 32}, {"cut_price": 10.0}):
        made = stock.plan(histogram, 12, **seen)
        assert {c: made.ranked[c] for c in histogram} == histogram


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 4)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 20))
def test_fullest(items, room):
    items = sorted(items)
    sizes, left = [s for s, _ in items], [n for _, n in items]
    sums = {0}
    for s, n in items:
        sums = {t + s * k for t in sums for k in range(n + 1) if t + s * k <= room}
    counts = stock.fullest(sizes, left, room)
    assert all(c <= n for c, n in zip(counts, left, strict=True)) and sum(s * c for s, c in zip(sizes, counts, strict=True)) == max(sums)


def check(rows, docs, sequence=stock.SEQUENCE):
    """Every id in one piece, right sums, sequences without gaps; returns padding as a share of the tokens."""
    want = Counter()
    for doc_id, text in docs:
        ids = np.append(encoded(text or ""), 2).astype("<u4")
        want[(doc_id, ids.tobytes())] += 1
    pieces, laid = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        laid[r.sequence_id].append((r.offset, r.length))
    for (doc_id, data), times in want.items():
        n = len(data) // 4
        same_length = [d for d in want if d[0] == doc_id and len(d[1]) == len(data)]
        spans = Counter((r.start, r.length, r.ids_crc32) for r in pieces[(doc_id, n)])
        if len(same_length) == 1:
            assert sum(length * k for (_, length, _), k in spans.items()) == n * times
        covered = Counter()
        for (start, length, crc), k in spans.items():
            if crc == zlib.crc32(data[4 * start:4 * (start + length)]):
                covered.update({i: k for i in range(start, start + length)})
        assert all(covered[i] >= times for i in range(n)) and (len(same_length) > 1 or set(covered.values()) == {times})
    assert set(pieces) == {(d, len(x) // 4) for d, x in want}
    padding = 0
    for spans in laid.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding / sum(len(x) // 4 * k for (_, x), k in want.items())


def test_table(spark, table):
    docs = table("documents")
    rows = stock.pack_tokens(docs, PATH).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.01
    again = stock.pack_tokens(docs.repartition(7), PATH).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (None, " \n"), (None, "a null id"), (3, "same words"), (3, "same words"), (3, "other words"), (4, "long " * 9000), (5, "<|endoftext|>")]
    docs = make_docs(rows)
    got = stock.pack_tokens(docs, PATH)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check(got.collect(), rows) == 0
    assert stock.pack_tokens(docs.limit(0), PATH).count() == 0


def test_hot_length_is_cut(make_docs):
    """A third of the rows are copies that are a little longer than half a sequence, and nothing fills their rest."""
    rows = [(i, "word " * 40) for i in range(60)] + [(100 + i, "text " * (50 + i)) for i in range(20)]
    got = stock.pack_tokens(make_docs(rows), PATH, sequence=64, width=2).collect()
    assert check(got, rows, 64) < 0.05
