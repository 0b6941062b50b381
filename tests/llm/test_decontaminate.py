"""Leaks against brute force over all windows."""

import random
from collections import Counter

from larder.llm.decontaminate import drop_leaks, find_leaks, item_classes

RNG = random.Random(4)
WORDS = [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "el", "io", "un")]


def passage(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def brute(docs, items):
    """Every (text, item) with a window of similarity 0.8."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for d, text in docs:
        for i, item in items:
            want, have = words(item), words(text)
            if not want or not have:
                continue
            k = min(5, len(want))
            bag = lambda w: Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
            b = bag(want)
            for s in range(max(1, len(have) - len(want) + 1)):
                a = bag(have[s:s + len(want)])
                same = sum((a & b).values())
                if a and same / (sum(a.values()) + sum(b.values()) - same) >= 0.8 - 1e-12:
                    found[d, i] = max(found.get((d, i), 0), same / (sum(a.values()) + sum(b.values()) - same))
    return found


def test_planted_passages(spark, make_docs):
    items = [(i, " ".join(passage(n))) for i, n in enumerate([3, 5, 12, 15, 30, 40, 55, 60])] + [(50, None), (51, "..."), (None, "lone zq words xk vv pp qq")]
    docs = [(100 + n, " ".join(passage(80))) for n in range(10)] + [(1, None), (2, ""), (3, "word")]
    for n, (i, text) in enumerate(items[:8]):
        words = text.split()
        docs.append((200 + n, " ".join(passage(20) + words + passage(30)).upper().replace(" ", ", ")))  # case and punctuation differ
        docs.append((300 + n, " ".join(passage(9) + words[:len(words) // 2] + ["new"] + words[len(words) // 2:] + passage(9))))  # a word comes in
        docs.append((400 + n, " ".join(words[1:])))
        docs.append((500 + n, " ".join(words[:-1] + ["other"])))
        docs.append((600 + n, " ".join((passage(5) + words) * 4)))
    docs += [(600, docs[-1][1]), (None, items[4][1]), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = make_docs(docs)
    got = {(r.id, r.item): r.similarity for r in find_leaks(frame, bench).collect()}
    want = brute(docs, items)
    assert {k for k in want if k[1] is not None} == set(got)
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    left = drop_leaks(frame, bench)
    leaking = {k[0] for k in want}
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in leaking and d is not None)


def test_reordered_passages(spark, make_docs):
    """Swapped halves, moved sentences and thirds in reverse order, within longer texts and near their ends."""
    items = [(i, " ".join(passage(n))) for i, n in enumerate([60, 60, 75, 90, 120])]
    docs = []
    for i, text in items:
        w = text.split()
        half, third = len(w) // 2, len(w) // 3
        for k, moved in enumerate([w[half:] + w[:half], w[12:] + w[:12], w[:20] + w[40:] + w[20:40], w[2 * third:] + w[third:2 * third] + w[:third]]):
            docs.append((100 * i + 10 * k, " ".join(passage(40) + moved + passage(50))))
            docs.append((100 * i + 10 * k + 1, " ".join(moved + passage(3))))
            docs.append((100 * i + 10 * k + 2, " ".join(passage(3) + moved[:-2])))
            docs.append((100 * i + 10 * k + 3, " ".join(passage(70) + moved + passage(7) + moved[:half] + passage(300) + moved)))
    got = {(r.id, r.item): r.similarity for r in find_leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 50 and set(want) == set(got)
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_items_of_the_same_words_and_nothing_to_find(spark, make_docs):
    bench = spark.createDataFrame([(4, "a b c d e f g"), (2, "A, b c d e f g!")], "item_id long, text string")
    docs = make_docs([(1, "x a b c d e f g y"), (1, "x a b c d e f g y")])
    assert [(r.id, r.item, r.start_word) for r in find_leaks(docs, bench).collect()] == [(1, 2, 1)]
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0
    assert drop_leaks(docs, bench).count() == 0 and drop_leaks(docs, bench.limit(0)).count() == 2


def test_short_items_lose_no_pair(spark, make_docs):
    """Items of 5 to 21 words against their beginnings, ends, and themselves with a word more."""
    items = [(1000 * n + k, " ".join(passage(n))) for n in range(5, 22) for k in range(40)]
    docs = []
    for i, text in items:
        w = text.split()
        docs += [(10 * i, " ".join(w[:-1])), (10 * i + 1, " ".join(w[1:])), (10 * i + 2, " ".join(w[:-2]))]
    near = lambda d, i: d[0] // 10 == i[0]
    want = {k for d in docs for i in items[d[0] // 10000 * 40 - 200:] [:40] if near(d, i) for k in brute([d], [i])}
    got = {(r.id, r.item) for r in find_leaks(make_docs(docs, False), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 700 and want <= got
    texts, wanted = dict(docs), dict(items)
    assert all(brute([(d, texts[d])], [(i, wanted[i])]) for d, i in got - want)


def test_classes_of_items(spark):
    rows = [(4, "a b c"), (2, "A, b c!"), (4, "a b c"), (None, "a b c"), (5, None), (6, ""), (None, "z"), (7, "c b a")]
    bench = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'clash' AS class", "'clash' AS words")
    got = {tuple(r) for r in item_classes(bench).collect()}
    assert got == {(4, 2), (2, 2), (None, 2), (5, 5), (6, 6), (None, None), (7, 7)}
    assert item_classes(bench.limit(0)).count() == 0


def test_table_equals_brute_force(table):
    docs, bench = table("documents"), table("benchmark")
    got = {(r.id, r.item) for r in find_leaks(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    some = [r for r in rows if r[0] in {d for d, _ in got}] + rows[:40]
    assert set(brute(some, items)) == {k for k in got if k[0] in {d for d, _ in some}} and got
