"""BPE encoding and decoding of whole texts by tree concatenation.

Pre-tokens come from :mod:`pretokens`; each distinct one is merged once and
kept in a bounded table. A long unsplit run is halved down to leaves, the
leaves are merged on their own, and each join re-encodes a window of tokens
around it that doubles until its first and last token agree with both sides.
A sequence in which every two neighbours are what encoding their joined text
gives is the encoding of the whole, so the agreement proves the join.

Texts longer than ``long_chars`` are cut into pieces that are rows of their
own and encoded in parallel by many tasks. Cuts are made before white space that
follows something else, where no pre-token goes on. A stretch without such a
place is cut into pre-tokens first, by the tokenizer's own rules; a long one of
these becomes several rows, whose ids are joined as in the tree.

Null or empty text has no ids. Rows are kept as they come: repeated rows and
null keys give one result each. Same-named columns of the input are replaced.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .common import extended, non_null_text, stage, text_slices, tokenizer_spec, with_columns

LEAF_BYTES = 2048        # an unsplit run up to this is merged at once
JOIN_TOKENS = 8          # first window on each side of a join
TABLE_WORDS = 200_000    # distinct pre-tokens in each of a worker's two tables
ENCODE_BYTES = 4 << 20   # text whose distinct pre-tokens are looked up together
LONG_CHARS = 200_000     # texts above are cut into pieces
PIECE_CHARS = 50_000
_MARK = b"\xff"          # stands for the word end; never a byte of UTF-8
_CODECS: dict[int, Codec] = {}


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others take code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent(dict):
    """Results of ``make`` by pre-token. When full, it becomes the older of two
    tables, from which what is used again comes back; very long ones aren't kept."""

    def __init__(self, make, size: int = TABLE_WORDS, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, word: bytes):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one tokenizer file with byte-level symbols."""

    def __init__(self, spec: str):
        import tiktoken

        self.spec = spec
        conf = json.loads(spec)
        model = conf["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.kind = "word" if self.suffix else "byte"
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.id_bytes = 2 if size <= 1 << 16 else 4
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        for ch, b in self.alphabet.items():
            ids[b] = vocab[ch]
            if self.suffix:
                ranks[bytes([b]) + _MARK] = 256 + b
                ids[256 + b] = vocab[ch + self.suffix]
        self.lengths = np.zeros(size, np.int64)
        self.ends_word = np.zeros(size, bool)
        for i, pair in enumerate(model["merges"]):
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            if ranks.setdefault(self.raw(token), 512 + i) == 512 + i:
                ids[512 + i] = vocab[token]
        for token, i in vocab.items():
            self.lengths[i] = len(self.raw(token)) - (bool(self.suffix) and token.endswith(self.suffix))
            self.ends_word[i] = not self.suffix or token.endswith(self.suffix)
        used = sorted(ranks.values())
        dense = {r: k for k, r in enumerate(used)}
        self.ids = ids[used]
        self.merge = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", special_tokens={},
                                       mergeable_ranks={t: dense[r] for t, r in ranks.items()})._core_bpe
        self.table = Recent(self.tree_bytes)

    @cached_property
    def library(self):
        """The tokenizers library's object, made when a text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.spec)
        found.no_padding()
        found.no_truncation()
        return found

    def raw(self, token: str) -> bytes:
        """Bytes of a vocabulary string, its word end as the mark."""
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: len(token) - len(self.suffix)] if end else token
        return bytes(self.alphabet[c] for c in body) + (_MARK if end else b"")

    def leaf(self, word: bytes, closed: bool = True) -> np.ndarray:
        """Ids of one pre-token (or of an inner part of one, if not closed)."""
        if not word:
            return np.zeros(0, np.uint32)
        return self.ids[self.merge.encode_single_piece(word + (_MARK if closed and self.suffix else b""))]

    def tree(self, word: bytes, closed: bool = True) -> np.ndarray:
        """Ids of one pre-token of any length."""
        if len(word) <= LEAF_BYTES:
            return self.leaf(word, closed)
        mid = len(word) // 2
        return self.join(word, self.tree(word[:mid], False), self.tree(word[mid:], closed), mid, closed)

    def join(self, word: bytes, left: np.ndarray, right: np.ndarray, mid: int, closed: bool) -> np.ndarray:
        """Join the ids of ``word[:mid]`` and ``word[mid:]``."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        n = JOIN_TOKENS
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            whole_left, whole_right = a == len(left), b == len(right)
            begin = mid - int(self.lengths[left[-a:]].sum())
            end = mid + int(self.lengths[right[:b]].sum())
            window = self.leaf(word[begin:end], closed and whole_right)
            if (whole_left or window[0] == left[-a]) and (whole_right or window[-1] == right[b - 1]):
                return np.concatenate([left[:-a], window, right[b:]])
            n *= 2

    def tree_bytes(self, word: bytes) -> bytes:
        return self.tree(word).tobytes()

    def word(self, word: bytes) -> bytes:
        """Little-endian ids of a pre-token."""
        return self.table[word]

    def words_of(self, text: str) -> Iterator[bytes | int]:
        """Pre-tokens of any text, by the library's rules; ids of special tokens."""
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    yield bytes(self.alphabet[c] for c in piece)

    def words_ids(self, words: Iterable[bytes | int]) -> bytes:
        return b"".join(np.uint32(w).tobytes() if isinstance(w, int) else self.word(w) for w in words)

    def odd(self, text: str) -> bytes:
        """Ids of a text with rare characters or the text of special tokens."""
        return self.words_ids(self.words_of(text))

    def encode(self, col: pa.Array) -> pa.Array:
        """Little-endian 32-bit ids of every text of a column without nulls."""
        plain = pretokens.plain_rows(col, list(self.special))
        if plain.all():
            return self._plain(col)
        edges = np.flatnonzero(np.diff(plain.astype(np.int8))) + 1
        parts = []
        for a, b in zip([0, *edges], [*edges, len(col)], strict=True):
            part = non_null_text(col.slice(a, b - a))
            parts.append(self._plain(part) if plain[a] else
                         pa.array([self.odd(t) for t in part.to_pylist()], pa.binary()))
        return pa.concat_arrays(parts)

    def _plain(self, col: pa.Array) -> pa.Array:
        words, first = pretokens.split(col, self.kind)
        if not len(words):
            return pa.array([b""] * len(col), pa.binary())
        coded = words.dictionary_encode()
        ids = pa.array(list(map(self.table.__getitem__, coded.dictionary.to_pylist())), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[first]
        return pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(ends.copy()), ids.buffers()[2]])

    @cached_property
    def spaced(self) -> pa.Array:
        return pa.array([s + " " for s in self.strings], pa.large_string())

    def decode(self, col: pa.Array) -> pa.Array:
        """Vocabulary strings of little-endian 32-bit ids, joined by spaces
        (what a tokenizer file without a decoder gives)."""
        offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4) // 4
        if offsets[0] == offsets[-1]:
            return pa.array([""] * len(col), pa.string())
        ids = np.frombuffer(col.buffers()[2], np.uint32)[offsets[0]: offsets[-1]]
        text = self.spaced.take(pa.array(ids))
        ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[offsets - offsets[0]]
        whole = pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer(ends.copy()), text.buffers()[2]])
        return pc.utf8_rtrim(whole, " ").cast(pa.string())


def codec(spec: str) -> Codec:
    """The worker's codec for a tokenizer file, built once."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


_CUT = re.compile(r"(?<=\S)[ \t\n\r]")


def cut_points(text: str, size: int) -> list[tuple[int, int, bool]]:
    """Pieces (begin, end, whole) of a text: runs of about ``size`` characters
    that end before white space, and (not whole) longer stretches without any."""
    out, begin = [], 0
    while begin < len(text):
        found = _CUT.search(text, begin + size)
        end = found.start() if found else len(text)
        if end - begin > 2 * size:
            # the place where the long stretch begins
            last = max((m.start() for m in _CUT.finditer(text, begin + 1, begin + size + 1)), default=begin)
            if last > begin:
                out.append((begin, last, True))
            out.append((last, end, False))
        else:
            out.append((begin, end, True))
        begin = end
    return out


#: A row of a long text: a whole piece, or coded words (pre-tokens, or None and
#: a special id), or a part of one long word that goes on in the next row.
_PIECE = "{row} long, piece_no long, piece_text string, piece_words array<binary>, piece_part binary, piece_open boolean"


def text_pieces(codec: Codec, text: str, size: int) -> Iterator[dict]:
    """The rows of a long text in order."""
    for begin, end, whole in cut_points(text, size):
        if whole:
            yield {"piece_text": text[begin:end]}
            continue
        words: list[bytes] = []
        held = 0
        for word in codec.words_of(text[begin:end]):
            if not isinstance(word, int) and len(word) > size:
                if words:
                    yield {"piece_words": words}
                for k in range(0, len(word), size):
                    yield {"piece_part": word[k: k + size], "piece_open": k + size < len(word)}
                words, held = [], 0
                continue
            # the id of a special token is marked by a byte that no pre-token begins with
            words.append(_MARK + np.uint32(word).tobytes() if isinstance(word, int) else word)
            held += len(words[-1])
            if held > size:
                yield {"piece_words": words}
                words, held = [], 0
        if words:
            yield {"piece_words": words}


def piece_ids(codec: Codec, piece: dict) -> bytes:
    """Ids of one row of a long text."""
    if piece["piece_text"] is not None:
        return codec.encode(pa.array([piece["piece_text"]], pa.string()))[0].as_py()
    if piece["piece_words"] is not None:
        return codec.words_ids(int.from_bytes(w[1:], "little") if w[:1] == _MARK else w for w in piece["piece_words"])
    return codec.tree(piece["piece_part"], not piece["piece_open"]).tobytes()


def join_pieces(codec: Codec, pieces: list[tuple[bytes | None, bool | None, bytes]]) -> bytes:
    """Ids of a text from its rows in order: (part, whether it goes on, ids)."""
    out, parts = [], []
    for part, goes_on, ids in pieces:
        if part is None:
            out.append(ids)
            continue
        parts.append((part, np.frombuffer(ids, np.uint32)))
        if not goes_on:
            out.append(_joined(codec, parts).tobytes())
            parts = []
    return b"".join(out)


def _joined(codec: Codec, level: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    """Join the encoded parts of one word, pair by pair, up a tree."""
    while len(level) > 1:
        above = []
        for k in range(0, len(level) - 1, 2):
            (a, left), (b, right) = level[k], level[k + 1]
            above.append((a + b, codec.join(a + b, left, right, len(a), k + 2 == len(level))))
        level = above + level[len(level) - len(level) % 2:]
    return level[0][1]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", long_chars: int = LONG_CHARS,
           keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) of every whole text.

    Short texts are encoded where they are read. Long ones are cut into pieces
    that any task may encode; only the pieces are shuffled. ``keep`` names the
    columns to give back (all of them by default); with ``decoded``, the text
    that the ids decode to is added in the same pass.
    """
    spec = tokenizer_spec(df.sparkSession, path)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != ids.lower()]
    base = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = extended(base, [T.StructField(ids, T.BinaryType())])

    def whole(batches):
        c = codec(spec.value)
        for batch in text_slices(batches, text, ENCODE_BYTES):
            col = non_null_text(batch.column(batch.schema.get_field_index(text)))
            found = {ids: c.encode(col)}
            if decoded:
                found[decoded] = c.decode(found[ids])
            yield with_columns(batch.select(keep), found)

    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    needed = [*keep, *([] if text in keep else [text])]
    both = extended(base, [*schema.fields[-1:], T.StructField(decoded, T.StringType())]) if decoded else schema
    short = df.where(size <= long_chars).select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(whole, both)
    # written once, so the numbers of the rows hold for pieces and rows alike
    row = f"row_{uuid.uuid4().hex}"
    long = stage(df.where(size > long_chars).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        return short
    most = min(PIECE_CHARS, max(long_chars // 4, 1))
    kind = T.StructType.fromDDL(_PIECE.format(row=row))
    arrow = pa.schema([(row, pa.int64()), ("piece_no", pa.int64()), ("piece_text", pa.string()), ("piece_words", pa.list_(pa.binary())),
                       ("piece_part", pa.binary()), ("piece_open", pa.bool_())])

    def cut(batches):
        c = codec(spec.value)
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, piece in enumerate(text_pieces(c, body.as_py(), most)):
                    yield pa.RecordBatch.from_pylist([{row: number, "piece_no": k, **piece}], schema=arrow)

    def code(batches):
        c = codec(spec.value)
        for batch in batches:
            coded = [piece_ids(c, p) for p in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in (row, "piece_no", "piece_part", "piece_open")),
                                              pa.array(coded, pa.binary())], names=[row, "piece_no", "piece_part", "piece_open", "piece_ids"])

    pieces = long.select(row, F.col(f"`{text}`")).mapInArrow(cut, kind).repartition(row, "piece_no")
    coded = pieces.mapInArrow(code, f"{row} long, piece_no long, piece_part binary, piece_open boolean, piece_ids binary")

    def joined(key, rows):
        rows = rows.sort_values("piece_no")
        return pd.DataFrame({row: [key[0]], ids: [join_pieces(codec(spec.value), list(zip(
            rows.piece_part, rows.piece_open, rows.piece_ids, strict=True)))]})

    whole_ids = coded.groupBy(row).applyInPandas(joined, T.StructType([
        T.StructField(row, T.LongType()), T.StructField(ids, T.BinaryType())]))
    coded = long.select(row, *[F.col(f"`{c}`") for c in keep]).join(whole_ids, row).drop(row)
    return short.unionByName(decode(coded, path, ids, decoded) if decoded else coded)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from the binary column ``ids`` (null: empty)."""
    spec = tokenizer_spec(df.sparkSession, path)

    def run(batches):
        c = codec(spec.value)
        for batch in text_slices(batches, ids, ENCODE_BYTES):
            col = pc.fill_null(batch.column(batch.schema.get_field_index(ids)), b"")
            yield with_columns(batch, {text: c.decode(pa.concat_arrays([col, col.slice(0, 0)]))})

    return df.mapInArrow(run, extended(df, [T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return encode(docs.select("doc_id", "text"), path, keep=["doc_id"], decoded="decoded").select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
