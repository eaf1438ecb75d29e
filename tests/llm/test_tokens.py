import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from panelcast.llm import bpe, pretokens, token_counts, token_ids

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codecs():
    return {p: (bpe.Codec(open(p, encoding="utf-8").read()), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


def ids(codec, texts):
    return [np.frombuffer(x, np.uint32).tolist() for x in codec.encode(pa.array(texts, pa.string())).to_pylist()]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(codecs, path):
    codec, library = codecs[path]
    random.seed(3)
    parts = ["'", "s", "t", "ll", "re", "ve", "d", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1f", "é", "ß", "Ž", "1", "²", "!",
             "_", "A", "<|endoftext|>", "<|startoftext|>", "日", "’", "ﬁ", "é", "İ", "Σ", "\U0001f600"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(1500)]
    texts += ["it's 'start' ''s we'll''ll", "a" * 9000 + "b", "the" * 5000, "\n" * 50, "'Sup 'LL 't't't"]
    assert ids(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point_of_the_fast_path_is_split_like_the_library(codecs):
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}'s" for c in range(1, 0x180)]
    for path in (WORD, BYTE):
        codec, library = codecs[path]
        assert ids(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehlnorst", min_size=1, max_size=400), st.integers(1, 60), st.booleans())
def test_tree_concatenation_equals_merging_at_once(text, leaf, closed):
    codec = test_tree_concatenation_equals_merging_at_once.codec
    word = text.encode()

    def tree(w, end):
        if len(w) <= leaf:
            return codec.leaf(w, end)
        mid = len(w) // 2
        return codec.join(w, tree(w[:mid], False), tree(w[mid:], end), mid, end)

    assert tree(word, closed).tolist() == codec.leaf(word, closed).tolist()


test_tree_concatenation_equals_merging_at_once.codec = bpe.Codec(open(WORD, encoding="utf-8").read())


def test_pieces_cover_a_text_and_end_before_white_space():
    for text in ("ab " * 50 + "x" * 500 + "日" * 300, " " * 90 + "a", "a  \n b " * 40, "x" * 300, "ab\x1c \x1c " * 50):
        found = bpe.cut_points(text, 40)
        assert "".join(text[a:b] for a, b, _ in found) == text
        for a, b, whole in found[1:]:
            assert text[a] in " \t\n\r" and not text[a - 1].isspace()
            assert b - a <= 80 or not whole
    assert bpe.cut_points("", 40) == []


def _hard_texts(n):
    """Long texts whose pre-tokens are hard to cut; n letters in the long runs."""
    r = random.Random(5)
    letters = lambda k, own="abcdefghijklmnopqrstuvwxyz": "".join(r.choices(own, k=k))
    return ["é" + letters(n), "it's" + letters(n), "word " * (n // 27) + "é" + letters(n), "ж" + letters(n) + "ж",
            (letters(80) + "é") * (n // 80), letters(n // 5) + "it's" + letters(n // 5), "日本語" * (n // 3), letters(n, "日本語,。1 "),
            letters(n, "aé'stж1 \x1c\x85\u00a0!"), "'s" * (n // 2), "a" * n + "<|endoftext|>" + "'ll" * 200 + "e\u0301" * (n // 4),
            " \n" * (n // 2) + "x" * n, "the" * n + " and Then it's <|endoftext|> " + "lo" * n + "!" * n + " 日本 " + "word " * 90]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("long_chars, n", [(400, 2400), (200_000, 240_000)])
def test_long_texts_have_the_library_ids(spark, codecs, path, long_chars, n):
    library = codecs[path][1]
    texts = [*_hard_texts(n), "short one", None, "", "z" * 399]
    if n > 100_000:
        texts = [t for t in texts if t is None or len(t) < 600_000]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, piece_row long").repartition(4)
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(df, path, long_chars=long_chars).collect()}
    wrong = [k for k, t in enumerate(texts)
             if got[k] != np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def test_digests_of_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORD)
    want = []
    for r in odd_docs.collect():
        found = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(odd_docs, WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(no_docs, WORD).count() == 0


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
                  for r in odd_docs.collect())
    got = token_counts.report(odd_docs, BYTE).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.report(no_docs, BYTE).count() == 0


def test_whole_tokens_are_proven_by_the_library():
    spec = open(BYTE, encoding="utf-8").read()
    library = Tokenizer.from_str(spec)
    whole = token_counts.whole_tokens(spec)
    assert len(whole) > 45_000 and b" the" in whole
    for raw in whole[::997]:
        assert len(library.encode(raw.decode(), add_special_tokens=False).ids) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200))
def test_variable_length_codes_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_ids.pack(ranks)
    assert len(control) == -(-len(values) // 4)
    assert token_ids.unpack(control, data, len(values)).tolist() == values


def test_damaged_blocks_are_refused():
    whole = token_ids.block(0, [1, None], np.array([2, 1]), np.array([5, 300, 70000], np.uint32)) + b"\n"
    first, docs, ranks = next(token_ids.blocks(whole))
    assert (first, docs["n"].tolist(), ranks.tolist()) == (0, [2, 1], [5, 300, 70000])
    for bad in (whole[:-1], b"X" + whole[1:], whole[:-3]):
        with pytest.raises(ValueError):
            list(token_ids.blocks(bad))


def test_files_of_ids_read_back(spark, odd_docs, no_docs, tmp_path):
    library = Tokenizer.from_file(WORD)
    docs = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for key, found in docs:
        want.append((str(key), start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    for size in (token_ids.SHARD_IDS, 40):
        path = str(tmp_path / f"files{size}")
        token_ids.write(odd_docs, path, WORD, 2, shard_ids=size)
        got = [(str(r["doc_id"]), r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in token_ids.read(spark, path).collect()]
        assert sorted(got) == sorted(want)
    assert token_ids.round_trip(no_docs, WORD).count() == 0


def test_shards_follow_the_ids_not_the_rows(spark):
    sizes = [5000 if 300 <= k < 340 else 1 for k in range(1000)]
    df = spark.createDataFrame([(k, n, b"") for k, n in enumerate(sizes)] + [(None, 3, b"")], "doc_id long, n_ids long, ids binary").repartition(4)
    bounds = token_ids.shard_bounds(df, 20_000)
    edges = [-1, *bounds, 1000]
    held = [sum(sizes[a + 1: b + 1]) for a, b in zip(edges, edges[1:], strict=False)]
    assert bounds == sorted(set(bounds)) and sum(held) == sum(sizes) and max(held) <= 25_000 and len(held) <= 16
    assert token_ids.shard_bounds(df.limit(0), 10) == [] and token_ids.shard_bounds(df, 10**9) == []


def test_plain_rows_leave_rare_text_to_the_library():
    col = pa.array(["abc", "é", "İ", "日", "x<|endoftext|>", ""])
    assert pretokens.plain_rows(col, ["<|endoftext|>"]).tolist() == [True, True, False, False, False, True]
