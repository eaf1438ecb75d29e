"""Quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import quality_rules as qr


WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def buckets(text):
    b = (text or "").encode()
    return [int.from_bytes(b[k:k + 4], "little") * 0x9E3779B1 % 2**32 >> 16 for k in range(len(b) - 3)]


def brute(docs, labels):
    """Verdict of every document, by dictionaries."""
    mark = {}
    for key, quality in labels:
        if key is not None and quality in (0, 1):
            mark[key] = max(quality, mark.get(key, 0))
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    raw, target = Counter(), Counter()
    for key, text in docs:
        raw.update(buckets(text))
        if mark.get(key) == 1 and fold(key) < 2:
            target.update(buckets(text))
    p, q = sum(target.values()) + 65536, sum(raw.values()) + 65536
    ratio = lambda b: round(math.log((target[b] + 1) / p / ((raw[b] + 1) / q)) * 2**20)
    out = []
    for key, text in docs:
        own = buckets(text)
        out.append((*plain(text), sum(map(ratio, own)) / 2**20 / len(own) if own else 0.0))
    bins = {}
    for (key, _), row in zip(docs, out, strict=True):
        if key is not None and key in mark and fold(key) == 3 and not row[5]:
            bins.setdefault(math.floor(row[6] * 256), [0, 0])[mark[key]] += 1
    cut = qr.best_cut({k: tuple(v) for k, v in bins.items()})
    return [(*row[:6], not row[5] and (cut is None or row[6] >= cut)) for row in out], cut


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\t\r#|é日\x1c\x00"), max_size=120), max_size=6))
def test_counts_equal_plain_ones(texts):
    got = qr.plain_counts(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][k]) for c in qr.COUNTS) for k in range(len(texts))] == [plain(t)[:5] for t in texts]


def test_repeated_windows_and_lines():
    w = [f"w{k}" for k in range(30)]
    text = " ".join(w + w[3:11]) + "\nline one\nline one\n \n \nline one "
    assert plain(text) == tuple(int(x[0]) for x in qr.plain_counts(pa.array([text])).values()) + (True,)
    assert plain(" ".join(w + w[3:11]))[4] == 16


def test_grams_stay_in_their_row():
    bucket, first, end = qr.grams(pa.array(["abcd", "abc", "", "éabc"]))
    assert [list(bucket[a:b]) for a, b in zip(first, end, strict=True)] == [
        buckets("abcd"), [], [], buckets("éabc")]


def test_cut_lies_between_the_kinds():
    assert qr.best_cut({-500: (3, 0), -100: (0, 2), 20: (0, 9)}) == (-499 - 100) / 2 / 256
    assert qr.best_cut({0: (0, 5)}) is None and qr.best_cut({}) is None
    assert qr.best_cut({0: (5, 0), 1: (0, 5)}) == 1 / 256


def test_report_equals_brute_force(spark, odd_docs, no_docs):
    good = [(k, " ".join(f"{a}{b}" for a in ("tal", "ren", "mo", "si") for b in ("ka", "lo", "ven", "du", "ris", f"x{k}"))) for k in range(60)]
    bad = [(k, " ".join(f"{a}{b}###" for a in ("tal", "ren", "mo", "si") for b in ("ka", "lo", "ven", "du", "ris", f"x{k}"))) for k in range(60, 90)]
    docs = [*good, *bad, (None, good[0][1]), (3, bad[0][1]), (200, None), (201, ""), (202, "same words here again now ok yes no " * 4)]
    labels = [(k, 1) for k in range(0, 60)] + [(k, 0) for k in range(60, 90)] + [(None, 1), (5, None), (7, 0), (999, 1)]
    want, cut = brute(docs, labels)
    assert cut is not None
    df = spark.createDataFrame([(k, t, k) for k, t in docs], "doc_id long, text string, kept long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = qr.report(df, marks).collect()
    got = sorted(tuple(r[c] for c in ("doc_id", *qr.COUNTS, "base_failed", "kept")) for r in rows if r["doc_id"] is not None)
    assert got == sorted((k, *w) for (k, _), w in zip(docs, want, strict=True) if k is not None)
    assert {r["kept"] for r in rows if r["doc_id"] is None} == {True}
    kept = qr.keep(df, marks)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == sorted(t for (_, t), w in zip(docs, want, strict=True) if w[6])
    # no labels: only the plain rules reject; odd and empty tables
    rows = qr.report(odd_docs, marks.limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert qr.report(no_docs, marks).collect() == []


def test_held_out_fold_of_the_given_labels(spark):
    from .conftest import SF
    d = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(r["kept"], mark[r["doc_id"]]) for r in qr.report(docs, labels).collect()
            if r["doc_id"] in mark and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good = [k for k, q in rows if q == 1]
    bad = [k for k, q in rows if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


