"""Prefix trie against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import prefix_trie as pt

CONV = "conv_id long, turn long, role string, text string"
COLS = [*pt.COLUMNS, "ends_sha256"]


def plain(rows):
    """Nodes of the trie of the rebuilt conversations, by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + v[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {s: [t for t in members if t and t[:-1] == s] for s in members}
    below = {s: [t for t in members if t[: len(s)] == s] for s in members}
    own_saved = {s: (len(m) - 1) * (len(s[-1][1]) if s else 0) for s, m in members.items()}
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]),
                   sum(not kids[t] for t in below[s]), sum(own_saved[t] for t in below[s]),
                   hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest())
                  for s, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 700))
def test_findclose_and_leaf_pairs(seed, pairs):
    r = np.random.default_rng(seed)
    bits, left, open_now = [True], pairs - 1, 1
    while left or open_now > 1:
        if left and (open_now == 1 or r.random() < r.choice([0.5, 0.95, 0.3])):
            bits.append(True)
            left, open_now = left - 1, open_now + 1
        else:
            bits.append(False)
            open_now -= 1
    bits.append(False)
    stack, close = [], {}
    for k, b in enumerate(bits):
        if b:
            stack.append(k)
        else:
            close[stack.pop()] = k
    tree = pt.Parentheses(np.array(bits))
    opened = np.flatnonzero(tree.bits)
    closed = tree.findclose(opened)
    assert dict(zip(opened.tolist(), closed.tolist(), strict=True)) == close
    pairs_at = [k for k in range(len(bits) - 1) if bits[k] and not bits[k + 1]]
    assert tree.leaves(opened, closed).tolist() == [sum(a <= k < close[a] for k in pairs_at) for a in opened.tolist()]


def talks(seed, n, alphabet=3, longest=9):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(r.integers(0, longest))):
            rows.append((c * 7 % 523, t, ["user", "bot", None][int(r.integers(0, 3 if alphabet > 3 else 1))],
                         f"say {int(r.integers(0, alphabet))}é" if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("seed, alphabet", [(1, 2), (2, 5)])
@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_nodes_equal_plain_ones_in_any_shards(spark, seed, alphabet, most):
    rows = talks(seed, 130, alphabet)
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert got(pt.nodes(pt.rebuild(df), most)) == plain(rows)


def test_odd_conversations(spark):
    long = [(7, t, "user", "x" * (t % 5)) for t in range(700)]
    rows = [(None, 1, "user", "no key"), (101, None, "a", "null turn first"), (101, 0, "a", "then"), (101, 0, "b", "tie"), (101, 0, "b", "tie"),
            (100, 5, None, None), (102, 3, "", ""), (103, 1, "user", None), (-5, 1, "user", "below"), (-105, 1, "user", "below"),
            (2**62 + 1, 1, "u", "far"), (300, 1, "日本", "ok é"), (305, 1, "q", "own only"), *long, *[(8, *r[1:]) for r in long]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONV + ", n_convs long, ends_sha256 string")
    sign = lambda c: c - c % 100 if c >= 0 else c + -c % 100  # noqa: E731  SQL's %, unlike Python's, keeps the sign
    assert {sign(-5), sign(-105)} == {0, -100}
    want = plain([r for r in rows if r[0] is None or r[0] >= 0])
    assert got(pt.report(df.where("conv_id is null or conv_id >= 0"))) == want
    assert len(got(pt.report(df))) > len(want)
    assert got(pt.report(df.where("conv_id is null"))) == []
    assert pt.report(df.limit(0)).columns == COLS


def test_a_common_sequence_is_cut_between_shards(spark):
    rows = [(100 * k, 0, "user", "hi") for k in range(5000)] + [(100 * k, 1, "bot", "ho") for k in range(5000)]
    seqs = pt.rebuild(spark.createDataFrame(rows, CONV))
    assert got(pt.nodes(seqs, 300)) == plain(rows)
