"""Repaired conversations against a plain search over all edits, with blocks of a few rows so that conversations cross them."""

import heapq
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import repair

KIND = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        filled = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{filled[0]}:{filled[1]}".encode()) % 20
        role, text = filled[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: (r[0], r[1], r[2].encode(), r[3][:32].encode(), sha256(r[3].encode()).hexdigest())
    return {conv: sorted(own, key=key) for conv, own in out.items()}


def search(rows, faults):
    """Cheapest and then least letters, with the lines that they make: a search ordered by (cost, letters)."""
    grammar = re.compile("(s?(ua)+)?")
    partial = re.compile("(s?(ua)*u?)?")
    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and grammar.fullmatch(roles):
            return cost, letters, "\n".join(lines)
        state = (i, roles[-2:], roles.count("s"))
        if (state, letters) in best or (state,) in best:
            continue
        best |= {(state, letters), (state,)}
        options = [("I", 5, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i][2:]
            extra = 5 if faults[i] == 3 else 0
            options.append(("D", 2, "", None))
            if faults[i] in (0, 3):
                options += [("K", extra, role, f"{role}:{text}"), *[("R", 1 + extra, r, f"{r}:{text}") for r in ("user", "assistant")]]
        for letter, price, role, line in options:
            if letter != "D" and (not role or not partial.fullmatch(roles + role[0])):
                continue
            heapq.heappush(heap, (cost + price, letters + letter, i + (letter != "I"), roles + role[:1] * (letter != "D"), lines + ((line,) if line is not None else ())))
    raise AssertionError


def slow(rows):
    after, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own, seen, faults = after.get(conv, []), set(), []
        for _, _, role, text in own:
            kept = text.rstrip(SPACE)
            faults.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [r[1] for r in own if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, letters, text = search(own, faults)
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, letters, sha256(text.encode()).hexdigest())
    return out


def result(df, **more):
    rows = repair.repair(df, **more).collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


ROLES = ["user", "assistant", "system", "tool", "", "sys", "ü"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3]), st.integers(0, 3)), max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_paths_are_cheapest_and_least(rows, cuts):
    """A conversation in one segment and in several, against the search."""
    import numpy as np

    initial, fault = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int)
    want = search([(True, i, ["tool", "system", "user", "assistant"][r[0]], "x") for i, r in enumerate(rows)], fault.tolist())
    bounds, at = [0], 0
    for n in (cuts * 10):
        at = min(at + n, len(rows))
        bounds.append(at)
    for lengths in ([len(rows)], [b - a for a, b in zip(bounds, bounds[1:], strict=False) if b > a]):
        if not rows:
            continue
        paths = repair.Paths(initial, (fault == 1) | (fault == 2), fault == 3, np.array(lengths))
        passed = repair.through(*map(list, zip(*[paths.between(k) for k in range(len(lengths))], strict=True)))
        letters = "".join(e[1] for k, (s, t) in enumerate(passed) for e in paths.read(k, s, t)) + "I" * len(repair._ENDING[passed[-1][1]])
        assert letters == want[1]


def test_table(spark, table):
    df = table("conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = slow(rows)
    assert result(df) == want
    assert result(df.repartition(5), block_rows=4) == want


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (7, 5, "user", " "), (7, 9, "assistant", "A? \t\n\x0b")]
    rows += [(8, 3, "user", "same."), (8, 3, "user", "same."), (8, 3, "user", "other."), (9, -4, "assistant", "long text. " * 20_000), (9, 2, "user", "no end")]
    rows += [(c, t, ROLES[(c * 3 + t) % 7], ["Yes.", "", "why", "No!"][(c + t * t) % 4]) for c in range(20, 60) for t in range(c % 7)]
    rows += [(99, t, "system" if t % 5 == 0 else "user", f"Text {t}.") for t in range(40)]
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "dropped."))
    df = spark.createDataFrame(rows, KIND)
    clashes = ["conv", "copy", "copies", "place", "block", "opens", "fault", "initial", "kind", "edit", "blank", "text_key", "begins", "every", "cost", "audit"]
    want = slow(rows)
    assert want[lost] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert result(df.withColumns({c: F.lit("clash") for c in clashes})) == want
    assert result(df, block_rows=3) == want
    assert repair.repair(df.limit(0)).count() == 0


def test_hot_conversation(spark):
    """One conversation holds most rows; the blocks agree with a single one."""
    rows = [(1, t, ["user", "assistant", "user", "tool"][t * t % 4], f"Line {t * 7919 % 900}" + "." * (t % 3)) for t in range(3000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, KIND)
    small, large = result(df, block_rows=64), result(df, block_rows=1 << 20)
    assert small == large and small[1][5] > 0 and len(small[1][6]) >= 2700
