"""Toxicity, quality, fingerprints, WARC, HTML and the pipeline."""

import gzip
import hashlib
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import binary_files, fingerprint, html_text, logistic, quality, toxicity, warc

from .conftest import SF, frame

# WARC


def test_records_round_trip_and_damage_is_found():
    raw = warc.record(7, "http://x/\r\na", "päge".encode() * 9, None)
    found = warc.parse(next(warc.members(raw)))
    assert (found["page_id"], found["url"], found["payload"]) == (7, "http://x/ a", "päge".encode() * 9)
    assert found["payload_digest"] == hashlib.sha1("päge".encode() * 9).hexdigest()
    again = warc.parse(next(warc.members(warc.record(3, None, b"x", 7))))
    assert (again["record_type"], again["refers_to"], again["payload"]) == ("revisit", 7, None)
    plain = gzip.decompress(raw)
    for bad in (plain.replace("päge".encode(), "päGe".encode(), 1), plain[:-3], b"HTTP" + plain):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(raw[:-9]))


def test_members_of_a_large_archive_are_read_in_steps():
    payloads = [random.Random(k).randbytes(n) for k, n in enumerate([0, 10, 200_000, 70_000, 1])]
    archive = b"".join(warc.record(k, None, p, None) + warc.EMPTY_MEMBER for k, p in enumerate(payloads))
    assert [warc.parse(m)["payload"] for m in warc.members(archive)] == payloads
    assert gzip.decompress(archive).count(b"WARC/1.1") == 5


def test_archives_of_odd_pages(spark, tmp_path):
    big = "ü" * 600
    rows = [(1, "u1", big), (2, None, big), (9, "u9", big), (9, "u9", big), (None, "n", big), (3, "s", "small"), (4, "s", "small"),
            (5, None, None), (6, "e", ""), (7, "long", "<p>" + "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = sorted(map(tuple, warc.round_trip(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        again = t == big and i in (1, 2)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    path = str(tmp_path / "warc")
    warc.write(pages.drop("record_type"), path)
    one = binary_files.read_files(spark, path).first()["content"]
    assert gzip.decompress(bytes(one)).startswith(b"WARC/1.1")
    assert warc.round_trip(pages.limit(0)).count() == 0


# fingerprints


def brute_shingles(text, n=fingerprint.NGRAM):
    import regex

    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    out = set()
    for k in range(max(len(words) - n + 1, 1)) if words else ():
        h = 42
        for w in words[k: k + n]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), seed=h)
        out.add(h >> 64 - fingerprint.BITS)
    return sorted(out)


def brute_sketch(text, scale=fingerprint.SCALE, least=fingerprint.LEAST):
    """The sketch, and the hash that it is complete to."""
    every = brute_shingles(text)
    low = [h for h in every if h < (1 << fingerprint.BITS) // scale]
    kept = low if len(low) >= least else every[:least]
    return kept, 1 << fingerprint.BITS if len(kept) < least else max(kept[-1], (1 << fingerprint.BITS) // scale - 1)


def test_fingerprints_equal_brute_force(spark, no_docs):
    random.seed(6)
    texts = [" ".join(random.choices([f"w{k}é" for k in range(50)], k=random.choice([0, 3, 60, 70, 300, 900]))) for _ in range(30)]
    texts += ["", None, texts[2], "😀" * 10, "Same, TEXT here", "same text here"]
    rows = [(k * 3, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = frame(spark, rows).withColumn("sketch", F.lit(1)).withColumn("part", F.lit(2))
    got = {r["doc_id"]: r for r in fingerprint.report(docs).collect()}
    assert len(got) == len(rows)
    ids = sorted(got, reverse=True)
    text = {k * 3: t or "" for k, t in enumerate(texts)}

    def like(a, b):
        (x, to_x), (y, to_y) = brute_sketch(a), brute_sketch(b)
        x, y = ({h for h in kept if h <= min(to_x, to_y)} for kept in (x, y))
        return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0

    for k, i in enumerate(ids):
        own, after = text[i], text[ids[(k + 1) % len(ids)]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        r = got[i]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == hashlib.md5(own.encode()).hexdigest() + ":" + ",".join(f"{h:X}" for h in brute_sketch(own)[0])
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(own, edited), like(own, after)))
        x, y = set(brute_shingles(own)), set(brute_shingles(edited))
        if own != edited and max(len(x), len(y)) < fingerprint.LEAST:
            assert r["near_edited"] == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)
    assert fingerprint.report(no_docs).count() == 0


@pytest.mark.parametrize("coarse, size", [(256, 1 << 25), (4, 20), (3, 1)])
def test_next_rows_across_any_ranges(spark, coarse, size):
    random.seed(coarse)
    ids = random.sample(range(-10**6, 10**6), 60) + [10**15, None, 7 * 10**8]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprint.with_next(docs, coarse, size).collect()}
    order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
    assert got == {i: f"text of {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_sketches_merge_at_any_lengths(spark):
    random.seed(8)
    words = [f"w{k}" for k in range(3000)]
    pairs = []
    for k in (0, 3, 30, 67, 68, 69, 90, 400, 2500):
        for m in (0, 20, 68, 300, 2900):
            start = random.randrange(100)
            pairs.append((" ".join(words[start: start + k]), " ".join(words[100: 100 + m])))
    a, b = F.col("a"), F.col("b")
    for scale, least in ((8, 64), (1, 1), (4, 1), (64, 10)):
        x, y = fingerprint.sketch(a, 5, scale, least), fingerprint.sketch(b, 5, scale, least)
        for r in spark.createDataFrame(pairs, "a string, b string").select(
                a, b, fingerprint.merge(x, y, scale, least).alias("m"),
                fingerprint.containment(x, y, scale, least).alias("c")).collect():
            union = sorted(set(brute_shingles(r["a"])) | set(brute_shingles(r["b"])))
            low = [h for h in union if h < (1 << fingerprint.BITS) // scale]
            assert r["m"] == (low if len(low) >= least else union[:least])
            if brute_shingles(r["a"]) and set(brute_shingles(r["a"])) <= set(brute_shingles(r["b"])) and r["c"] is not None:
                assert r["c"] == 1.0


def test_odd_rows_and_merged_sketches(spark, odd_docs):
    rows = fingerprint.report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 1
    one = fingerprint.report(odd_docs.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    long = " ".join(f"w{k}" for k in range(4000))
    df = spark.createDataFrame([(long, " ".join(f"w{k}" for k in range(400)))], "a string, b string")
    r = df.select(fingerprint.containment(fingerprint.sketch(F.col("b")), fingerprint.sketch(F.col("a"))).alias("c"),
                  (fingerprint.merge(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))
                   == fingerprint.sketch(F.col("a"))).alias("m")).first()
    assert r["c"] == 1.0 and r["m"]


def test_short_texts_have_the_likeness_of_their_words(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(5 + k % 9)) for k in range(40)]
    rows = {r["doc_id"]: r for r in fingerprint.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = lambda t: {tuple(w[k: k + 5]) for w in [t.split()] for k in range(max(len(w) - 4, 1))}
    for k, t in enumerate(texts):
        cut = len(t) // 3
        a, b = grams(t), grams(t[: len(t) - cut] + texts[k - 1][:cut])
        assert rows[k]["near_edited"] == pytest.approx(len(a & b) / len(a | b))
        assert len(rows[k]["fingerprint"].split(":")[1].split(",")) == len(a)


# toxicity


def test_folding_and_exceptions():
    model = toxicity.Model({"trash": 5.0, "moron": 5.0}, np.array([1.0, 1.0, -3.0]))
    found = model.automaton()
    assert toxicity.evidence(found, "m0r0n")[0] > 0 and toxicity.evidence(found, "ТRАSH Mоrоn")[0] > 0
    assert toxicity.evidence(found, "take the trash can out") == (0.0, 0.0)
    assert toxicity.evidence(found, "oxymoron xtrash") == (0.0, 0.0)
    short, long = (toxicity.evidence(found, "trash " + "word " * n) for n in (5, 500))
    assert short[0] == long[0] and short[1] > long[1]


def test_lexicon_keeps_the_telling_beginnings():
    toxic = {"vile": 90, "vilex": 30, "viley": 30, "path": 40, "pathe": 40, "pathet": 39, "them": 95}
    found = toxicity.choose(toxic, {"them": 900}, 100, 1000)
    assert set(found) == {"vile", "pathet"}


def test_words_of_copied_toxic_texts_are_not_needed():
    rows = [{"vile": 2, "grim": 1} for _ in range(20)] + [{"grim": 1, "nasty": 2}] * 5 + [{"vile": 3, "copied": 1, "words": 4}] * 9
    found = toxicity.needed({"vile": 5.0, "grim": 4.0, "nasty": 4.0, "copied": 6.0, "words": 6.0},
                            {"vile": 29, "grim": 25, "nasty": 5, "copied": 9, "words": 9}, rows, 3)
    assert set(found) == {"vile", "grim", "nasty"}


def auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    n = int(sum(y))
    return (order[np.array(y) == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def planted(spark, n=400):
    random.seed(8)
    docs, labels = [], []
    for k in range(n):
        bad, poor = k % 5 == 0, k % 4 == 1
        own = random.choices([f"wo{j}rd" for j in range(90)], k=60)
        if bad:
            own[3], own[17] = random.choice(["vilefoo", "vilebar", "v1lebaz"]), "nasty"
        text = " ".join(w.upper() + "!!" for w in own) if poor else " ".join(own) + "."
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(not poor), int(bad)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_rows_are_told_apart(spark, op, label):
    docs, labels = planted(spark)
    rows = op.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r[label] for r in rows], [r["score"] for r in rows]) > 0.98
    assert np.mean([r["predicted"] == r[label] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("op, drop", [(toxicity, toxicity.drop_toxic), (quality, quality.drop_poor)])
def test_classifiers_take_odd_rows(spark, odd_docs, no_docs, op, drop):
    docs, labels = planted(spark, 60)
    more = labels.union(spark.createDataFrame([(None, 1, 1), (2, None, None), (3, 0, 1), (3, 1, 0), (77777, 1, 1)], labels.schema))
    every = docs.unionByName(odd_docs.select(*docs.columns))
    assert op.report(every, more).where("score is not null and predicted in (0, 1)").count() == every.count()
    assert drop(odd_docs, more).columns == odd_docs.columns
    assert op.report(no_docs, more).count() == 0
    none = op.report(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and all(r["score"] <= 0.5 for r in none)


def test_every_unlabelled_row_takes_part(spark):
    docs, labels = planted(spark, 60)
    more = frame(spark, [(1000 + k, ("WORD!! " if k % 4 == 1 else "word. ") * (k % 7 + 3), "en", f"s{k % 3}", 60) for k in range(9000)])
    model = quality.train(docs.unionByName(more).repartition(5), labels)
    assert len(model.rounds) == quality.ROUNDS
    assert max(n for r in model.rounds for n in r) > 0.3 * 0.7 * 9000  # more than a pool of 6000 rows can give


def test_pool_sums_equal_a_fit_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text, page = rng.normal(size=(700, 4)).astype("f4").astype(float), rng.normal(size=(700, 3)).astype("f4").astype(float)
    truth = (text[:, 0] * 3 + page[:, 0] * 3 + rng.normal(size=700) > 0).astype(float)
    known = np.arange(100)
    rows = [(text[k].astype("<f4").tobytes(), page[k].astype("<f4").tobytes()) for k in range(100, 700)]
    pool = spark.createDataFrame(rows, "text_x binary, page_x binary")
    held = known % 4 == 0
    args = (text[known], page[known], truth[known], np.full(100, 50.0), held)
    one = quality.co_train(*args, pool.repartition(1), rounds=1)
    monkeypatch.setattr(quality, "MOST_SUMS", 2)
    two = quality.co_train(*args, pool.repartition(7), rounds=1)
    assert np.allclose(one.text.beta, two.text.beta, atol=1e-6) and one.rounds == two.rounds
    first = quality.co_train(*args, pool, rounds=0)
    base = truth[known][~held].mean()
    odds = first.page.odds(page[100:])
    label, share = quality.pseudo(odds, quality.surest(np.bincount(quality._bins(odds), minlength=quality.BINS), base))
    assert 0 < share.sum() <= 0.3 * 600 + 1e-9
    x = (np.vstack([text[known][~held], text[100:]]) - one.text.mean) / one.text.scale
    want = logistic.fit(x, np.concatenate([truth[known][~held], label]), np.concatenate([np.full((~held).sum(), 50.0), 0.3 * share]), l2=20.0)
    assert np.allclose(one.text.beta, want, atol=1e-5)


# HTML


def test_main_text_of_marked_articles():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body><nav><a href=x>Menu</a>
    </nav><div class="ad">Buy this</div><header><p>Site</p></header><article><header><h1>A&amp;B &#233;</h1></header><p><b>One
    two<br><p>Sh&ouml;rt.<!-- no --><div class="share">Share</div><div id="userComments"><p>Me too</p></div><ul><li>x<li>y</ul>
    <a href="/">only a link here</a></article><aside>Side</aside><footer>&copy;</footer>"""
    assert html_text.main_text(page) == "A&B é One two Shört. x y"


def test_the_closest_mark_of_an_article_counts():
    page = """<main><p>Teaser</p><article class="post has-sidebar"><p>Own text</p><p>More</p></article>
    <article class="comment"><p>Nice</p></article></main><div class="content">Else</div>"""
    assert html_text.main_text(page) == "Own text More"
    assert html_text.main_text(page.replace("article", "div")) == "Teaser Own text More"
    assert html_text.main_text("<div id=topNav>a</div><div class='entry-content'><p>b</p><div class=adBox1>c</div></div>") == "b"


def test_two_passes_without_an_article():
    good = "this is the text of the page and it has the words that are in it for us to read on and on " * 3
    page = (f"<body><p><a href=a>Home</a> <a href=b>News</a></p><h2>Head</h2><p>{good}</p><p>Short one.</p><p>{good}</p>"
            f"<p>Nothing near</p><p>Buy Cheap Stuff Online Great Prices Big Choice Fast Shipping Worldwide Safe Payment Top Brands</p>"
            f"<p>Tail words</p><div class='sidebar'><p>{good}</p></div>")
    text = html_text.main_text(page)
    assert text.count("this is the text") == 6 and "Short one." in text and "Head" in text
    assert "Buy Cheap" not in text and "Home" not in text and "Tail words" not in text


def test_rules_decide_inside_parts_marked_by_name():
    good = "this is the text of the page and it has the words that are in it for us to read on and on " * 3
    advert = "Buy Cheap Stuff Online Great Prices Big Choice Fast Shipping Worldwide Safe Payment Top Brands"
    text = html_text.main_text(f"<div id=content><p>{good}</p><p>Short one.</p><p>{good}</p><p>{advert}</p><p>{advert}</p></div>")
    assert text.count("this is the text") == 6 and "Short one." in text and "Buy" not in text
    foreign = "лорем ипсум долор сит амет " * 9
    assert html_text.main_text(f"<div class=content><p>{foreign}</p><p>{foreign}</p></div>").count("лорем") == 18


def test_the_part_with_most_of_the_text_counts():
    body = "this is the text of the page and it has the words that are in it for us to read on and on " * 3
    for tag in ("main", "div class=content"):
        text = html_text.main_text(f"<{tag}><p>{body}</p><article><p>A card</p></article><p>{body}</p></{tag.split()[0]}>")
        assert text.count("this is the text") == 6
    assert html_text.main_text(f"<p>{body}</p><div class=post><p>Teaser</p></div><p>{body}</p>").count("this is the text") == 6


def test_both_passes_run_inside_a_marked_article():
    body = "This is the text that we have for you and it is about the way in which they were made. " * 3
    advert = "Buy cheap watches now limited offer save money today click order fast shipping worldwide quality brand names " * 4
    page = f"<article><h1>Title</h1><p>{body}</p><div>{advert}</div><p>{body}</p><p>Short end.</p></article>"
    assert html_text.main_text(page) == f"Title {body.strip()} {body.strip()} Short end."
    # a paragraph, a quoted or a preformatted part stays between good text
    for tag in ("p", "pre", "blockquote"):
        held = page.replace("<div>", f"<{tag}>").replace("</div>", f"</{tag}>")
        assert advert.split()[1] in html_text.main_text(held)
    # an article of short lines, of few words, or without a known stop word is kept
    assert html_text.main_text("<article><div>One line</div><div>Next line</div></article>") == "One line Next line"
    foreign = "лорем ипсум долор сит амет " * 10
    assert html_text.main_text(f"<article><div>{foreign}</div><div>лорем</div></article>").count("лорем") == 11


def brute_second_pass(labels, headings):
    """Labels of short and near blocks by looking at every other block."""
    out = []
    for k, x in enumerate(labels):
        decided = [j for j, y in enumerate(labels) if y in ("good", "bad")]
        left, right = [j for j in decided if j < k], [j for j in decided if j > k]
        if x in ("good", "bad"):
            out.append(x)
        elif not decided:
            out.append("good")
        elif not left or not right:
            only = labels[left[-1] if left else right[0]]
            out.append("good" if x == "near" and headings[k] else only)
        elif labels[left[-1]] == labels[right[0]]:
            out.append("good" if x == "near" and headings[k] else labels[right[0]])
        elif x == "near" or headings[k] and labels[right[0]] == "good":
            out.append("good")
        else:
            out.append(labels[min((left[-1], right[0]), key=lambda j: abs(j - k))])
    return out


def test_second_pass_against_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        labels = [draw.choice(["good", "bad", "near", "short"]) for _ in range(draw.randint(0, 12))]
        headings = [draw.random() < 0.2 for _ in labels]
        found = [html_text.Block("x", 0, h, 0, label=y) for y, h in zip(labels, headings)]
        html_text.second_pass(found)
        assert [b.label for b in found] == brute_second_pass(labels, headings)


def test_links_of_an_article_stay_next_to_its_text():
    page = "<article><p>Read these:</p><ul><li><a href=a>First book</a><li><a href=b>Second book</a></ul></article>"
    assert html_text.main_text(page) == "Read these: First book Second book"
    assert html_text.main_text("<article><p>One</p><p><a href=a>linked words</a></p><p>Two</p></article>") == "One linked words Two"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<a><p></a>", "&#xZZ; &bogus;", "<p>" * 3000])
def test_broken_pages_have_a_text(page):
    assert isinstance(html_text.main_text(page), str)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<article>x  y\n</article>"), (3, "u", "<article>" + "<p>the word</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["n_chars"]) for r in html_text.report(pages).collect()}
    assert got == {(1, 0), (None, 3), (3, 50_000 * 9 - 1)}
    assert html_text.report(pages.limit(0)).count() == 0


# pipeline


def test_pipeline_equals_its_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = docs
    for op, drop, keep in ((toxicity, corpus_pipeline.drop_toxic, "predicted = 0"), (quality, corpus_pipeline.drop_poor, "predicted = 1")):
        wanted = {r["doc_id"] for r in op.report(left, labels).where(keep).collect()}
        left = drop(spark, left, SF)
        assert {r["doc_id"] for r in left.collect()} == wanted and left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
    from .brute import classes
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    wanted = {c for c, _ in classes(texts).values()}
    left = corpus_pipeline.one_of_each(spark, left, SF)
    left = spark.createDataFrame(left.collect(), docs.schema)
    assert {r["doc_id"] for r in left.collect()} == wanted
    from .test_ngram_join import brute_scan
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    wanted = set()
    for r in left.collect():
        n, hit, _ = brute_scan(r["text"], items)
        if not (hit and 20 * hit >= n):
            wanted.add(r["doc_id"])
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.collect()} == wanted
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_take_empty_tables(spark):
    none = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0



def test_broken_pages_take_time_in_proportion_to_their_size():
    import time
    for page in ("<p " * 330_000, "<a href='" * 110_000, "<p \"" * 200_000 + ">", '<p ">" ' * 120_000 + '"', "<div>x" * 150_000,
                 "<div>" * 90_000 + "</b>" * 180_000, "<!--" * 200_000, "<![CDATA[" * 100_000, "<a \"'>" * 150_000):
        begin = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - begin < 6
    assert html_text.main_text("<p >a < b <c") == "a < b <c"
    assert html_text.main_text("<article><p title='it's\">One</p><p>Two</p></article>") == "One Two"


def test_names_are_no_verdict_where_nothing_else_is_left():
    body = "This is the text of the page, and it is all that there is for you to read on it today. " * 3
    assert html_text.main_text(f"<div class='widget-text'><p>{body}</p></div>") == body.strip()
    assert html_text.main_text(f"<div class='widget-text'><p>{body}</p></div><article><p>Own</p></article>") == "Own"
    assert html_text.main_text(f"<nav><p>{body}</p></nav>") == ""


def test_a_language_without_known_words_is_read_by_length_and_links():
    text = "这是一个没有文章标记的中文网页，它的正文由几个段落组成，应当被完整地提取出来而不是丢失。"
    page = f"<body><div><a href=x>首页</a> <a href=y>新闻</a></div><div><p>{text * 3}</p><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"{text * 3} {text}"


def test_disguises_short_words_and_the_end_of_an_exception():
    own = toxicity.Model({"loser": 3.0, "idiot": 3.0, "ass|": 4.0, "trash": 2.5, "clown": 2.5}, None).automaton()
    found = lambda t: sorted(e for e, _ in toxicity.starts(own, t).values())
    assert found("You 1oser, 1diot and l0ser") == ["idiot", "loser", "loser"]
    assert found("an ass, no assay and no pass") == ["ass|"]
    assert found("a trash can, a clown fish") == []
    assert found("it is trash cannot you see, clown fishy") == ["clown", "trash"]
    assert toxicity.beginnings("Bad w0rds ab 1a") >= {"bad|", "word", "words", "ab|", "ia|", "la|"}
