import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import decontaminate, graph, ngram_join, ngram_sets

from .brute import classes, shingles, words
from .conftest import frame


def test_banding_meets_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.9999, 192)
    assert bands * rows <= 192 and 1 - (1 - 0.8 ** rows) ** bands >= 0.9999


def test_gram_sets_equal_brute_force():
    texts = ["A b c d e f a b c d e f", "one two", "", "é é é é é é É", "x.y-z 1 2 3"]
    grams, offsets = ngram_sets.gram_sets(pa.array(texts), 5)
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    want = [[len(set(a) & set(b)) for b in sets[:9]] for a in sets]
    assert ngram_join.overlaps(sets, sets[:9], chunk=37).tolist() == want
    own = ngram_join.overlaps(sets, None, chunk=37)[:, :9]
    assert all(own[i, j] == want[i][j] for i in range(20) for j in range(9) if i != j)


def near_texts(n_groups=12, seed=1):
    random.seed(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n_groups):
        base = random.choices(vocab, k=random.choice([3, 30, 120]))
        out.append(" ".join(base))
        for _ in range(random.randint(0, 9)):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = random.choice(vocab)
            out.append(random.choice([str.upper, str.title, str])(" ".join(copy)) + random.choice(["", "!", " ."]))
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    texts = near_texts() + ["", None, "!!", "solo text of five words"]
    docs = frame(spark, [(100 + k, t, "en", "s", 1) for k, t in enumerate(texts)])
    want = classes({100 + k: t or "" for k, t in enumerate(texts)})
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()}
    assert kept == {c for c, _ in want.values()}


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    rows = ngram_join.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["class_id"] for r in by[None]] == [None]
    assert {r["n_copies"] for r in by[5]} == {2} and {r["n_links"] for r in by[5]} == {1}
    assert by[1][0]["class_id"] == by[2][0]["class_id"] == by[6][0]["class_id"] == 1
    assert ngram_join.join(no_docs).count() == 0
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None"]
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_components_equal_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(None, 3)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in used}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination

def bench(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def brute_scan(text, items, size=13):
    doc, hit, found = words(text, full=False), set(), set()
    for k, item in enumerate(items):
        own = words(item, full=False)
        n = min(size, len(own))
        grams = {tuple(own[i: i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1) if n else ():
            if tuple(doc[i: i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(k)
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 20])
def test_scan_equals_brute_force(spark, block):
    random.seed(4)
    vocab = ["a", "b", "Cé", "d1", "E"]
    items = [" ".join(random.choices(vocab, k=k)) for k in (1, 2, 13, 14, 20, 30)] + ["", None, "!!"]
    texts = [" ".join(random.choices(vocab, k=random.randint(0, 60))) for _ in range(30)]
    texts += [f"zz {items[4]} yy. {items[5]}!", "only words from nowhere", None, ""]
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
           for r in decontaminate.scan(docs, bench(spark, items[1:]), block_windows=block).collect()}
    assert got == {k: brute_scan(t or "", [x or "" for x in items[1:]]) for k, t in enumerate(texts)}


def test_contaminated_documents_go_and_spans_are_cut(spark, odd_docs, no_docs):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, f"Start of it, {item}; the end", "en", "s", 1), (2, "clean", "en", "s", 1),
            (3, " ".join(f"w{k}" for k in range(500)) + " " + item, "en", "s", 1), (4, None, "en", "s", 1)]
    docs = frame(spark, rows)
    b = bench(spark, [item])
    assert sorted(r["doc_id"] for r in decontaminate.drop_documents(docs, b).collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, b).collect()}
    assert cut[1] == "Start of it, ; the end" and cut[2] == "clean" and cut[4] is None and "q3" not in cut[3]
    assert decontaminate.report(odd_docs, b).count() == odd_docs.count()
    assert decontaminate.drop_documents(odd_docs, b).columns == odd_docs.columns
    assert decontaminate.report(no_docs, b).count() == 0
    empty = decontaminate.report(docs, bench(spark, [])).collect()
    assert {r["n_hit"] for r in empty} == {0}


def test_one_of_each_with_clashing_columns_and_ties(spark):
    from panelcast.llm import ngram_join
    body = "one two three four five six seven eight nine ten"
    rows = [(1, body, "b", 7), (1, body, "a", 8), (2, body, "c", 9), (None, body, "d", 1), (3, "another text of its own here", "e", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, u long").repartition(3)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
