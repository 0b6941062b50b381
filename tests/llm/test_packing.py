from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm.neardup import clusters
from larder.llm.packing import pack, pack_documents


def slow_pack(lengths, sources, clusters, capacity):
    """The tightest compatible bin, all bins tried."""
    bins, placed = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [(rest, b) for b, (rest, s, c) in enumerate(bins) if rest >= lengths[i] and sources[i] not in s and clusters[i] not in c]
        b = min(fit)[1] if fit and lengths[i] else len(bins)
        if b == len(bins):
            bins.append([capacity, set(), set()])
        bins[b][0] -= lengths[i]
        bins[b][1] |= {sources[i]} - {None}
        bins[b][2].add(clusters[i])
        placed[i] = b
    return placed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.integers(0, 6)), max_size=40))
def test_same_bins_as_trying_all(items):
    lengths, sources, clusters = [x[0] for x in items], [x[1] for x in items], [x[2] for x in items]
    assert pack(lengths, sources, clusters, 20) == slow_pack(lengths, sources, clusters, 20)


def test_documents(make_docs):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 37 + 1)), f"s{i % 5}" if i % 7 else None) for i in range(200)]
    rows += [(900, "long " * 250, "s1"), (901, "same words", "s2"), (902, "Same  words", "s3"), (901, "same words", "s2"), (903, None), (904, ""), (None, "no id"), (None, "  \n")]
    docs = make_docs(rows)
    got = pack_documents(docs, capacity=100, group_rows=64).collect()
    words = Counter()
    for d, t, *_ in rows:
        words[d] += len((t or "").split())
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_words
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in have.items() if v}
    source = {r[0]: r[2] if len(r) > 2 else "s" for r in rows}
    for pieces in bins.values():
        assert sum(p.n_words for p in pieces) <= 100 and {p.bin_words for p in pieces} == {sum(p.n_words for p in pieces)}
        known = [source[p.doc_id] for p in pieces if source[p.doc_id]]
        assert len(known) == len(set(known)) and sum(p.doc_id in (901, 902) for p in pieces) <= 1
    assert sorted((r.piece, r.start, r.n_words) for r in got if r.doc_id == 900) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert sorted(str(r.doc_id) for r in got if r.bin_id is None) == ["903", "904", "None"] and all(r.n_words == 0 for r in got if r.bin_id is None)
    assert pack_documents(docs.limit(0)).count() == 0


def test_hot_source_and_cluster(make_docs):
    rows = [(i, "copy of a text" if i % 3 == 0 else f"text number {i}", "hot" if i % 3 == 1 else f"s{i}") for i in range(300)]
    got = pack_documents(make_docs(rows), capacity=50).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r.doc_id % 3)
    assert len(got) == 300 and all(b.count(0) <= 1 and b.count(1) <= 1 for b in bins.values())


def test_query_keeps_near_copies_apart(make_docs, tmp_path):
    """Near copies of different and null sources, one with a null id, meet in no sequence."""
    from larder.llm.queries import QUERIES

    base = [f"word{i}" for i in range(600)]
    rows = [(i, " ".join(base[:500 + i] + [f"end{i}"]), f"s{i}" if i % 2 else None) for i in range(8)]
    rows += [(100 + i, " ".join(f"t{i}x{j}" for j in range(300)), f"o{i}") for i in range(20)] + [(None, " ".join([*base[:509], "last"]), "n")]
    docs = make_docs(rows, clashes=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cluster = {r.id: r.cluster for r in clusters(docs).collect()}
    near = {d for d in cluster if list(cluster.values()).count(cluster[d]) > 1}
    assert len(near) >= 6 and not near & set(range(100, 120))
    bins = defaultdict(list)
    for r in QUERIES["op5_packing"](docs.sparkSession, str(tmp_path)).collect():
        bins[r.bin_id].append(cluster[r.doc_id])
    assert sum(map(len, bins.values())) == len(rows) and all(len(b) == len(set(b)) for b in bins.values())
    assert max(map(len, bins.values())) > 1


def test_groups_are_counted_from_pieces(make_docs):
    docs = make_docs([(i, " ".join([f"w{i}"] * 5000), f"s{i}") for i in range(8)], clashes=False)
    got = pack_documents(docs, capacity=50, group_rows=100).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(got) == 800 and len(groups) > 4 and max(groups.values()) < 200


def test_bins_do_not_depend_on_partitions(make_docs):
    from larder.llm.packing import pack_apart

    rows = [(i % 150, " ".join(f"w{i % 90}x{j}" for j in range(i % 41)), f"s{i % 6}" if i % 5 else None) for i in range(400)]
    docs = make_docs(rows)
    for form in (lambda d: pack_documents(d, 100, group_rows=64), lambda d: pack_apart(d, 100, group_rows=64)):
        few, many = ([tuple(map(str, r)) for r in form(docs.repartition(n)).collect()] for n in (2, 5))
        assert sorted(few) == sorted(many) and len(few) >= 400
