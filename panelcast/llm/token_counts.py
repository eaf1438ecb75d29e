"""Token counts of whole texts with a whole-token shortcut.

Before the job, every vocabulary string is encoded alone by the tokenizers
library; those that are one pre-token and come back as their own single id
are proven whole. Counting then needs no merges for a pre-token that is such a
string: it is one token. Only the other pre-tokens are merged, each distinct
one once per slice of rows.

Null or empty text has no tokens. One row comes back for each input row, so
repeated rows and null keys keep theirs; same-named columns are replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens
from .bpe import ENCODE_BYTES, Codec, Recent, codec
from .common import extended, non_null_text, text_slices, tokenizer_spec, with_columns

CONTEXT_TOKENS = 1024
_COUNTS: dict[int, Recent] = {}


def whole_tokens(spec: str) -> list[bytes]:
    """Vocabulary strings (as bytes) that alone are one pre-token and one token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    conf = json.loads(spec)
    own = Codec(spec)
    specials = set(own.special)
    strings, ids = [], []
    for token, i in conf["model"]["vocab"].items():
        if token in specials:
            continue
        raw = own.raw(token)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # no text has it as a pre-token
        strings.append((raw, text))
        ids.append(i)
    found = library.encode_batch([t for _, t in strings], add_special_tokens=False)
    return [raw for (raw, text), i, e in zip(strings, ids, found, strict=True)
            if e.ids == [i] and len(library.pre_tokenizer.pre_tokenize_str(text)) == 1]


def _column(codec: Codec, whole: frozenset[bytes], table: Recent, col: pa.Array) -> np.ndarray:
    """Token counts of a column without nulls."""
    plain = pretokens.plain_rows(col, list(codec.special))
    out = np.zeros(len(col), np.int64)
    for i in np.flatnonzero(~plain):
        # cut by the library's rules; a special token is one token like a proven string
        out[i] = sum(1 if isinstance(w, int) or w in whole else table[w] for w in codec.words_of(col[int(i)].as_py()))
    texts = col if plain.all() else non_null_text(col.filter(pa.array(plain)))
    words, first = pretokens.split(texts, codec.kind)
    if len(words):
        coded = words.dictionary_encode()
        sizes = np.array([1 if w in whole else table[w] for w in coded.dictionary.to_pylist()], np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])[first]
        out[plain] = np.diff(total)
    return out


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of every whole text."""
    spark = df.sparkSession
    spec = tokenizer_spec(spark, path)
    proven = spark.sparkContext.broadcast(frozenset(whole_tokens(spec.value)))  # at most the vocabulary

    def run(batches):
        c, whole = codec(spec.value), proven.value
        table = _COUNTS.setdefault(hash(spec.value), Recent(lambda word: len(c.tree(word))))
        for batch in text_slices(batches, text, ENCODE_BYTES):
            col = non_null_text(batch.column(batch.schema.get_field_index(text)))
            yield with_columns(batch, {n_tokens: pa.array(_column(c, whole, table, col))})

    return df.mapInArrow(run, extended(df, [T.StructField(n_tokens, T.LongType())]))


def report(docs: DataFrame, path: str, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    counted = count_tokens(docs.select("doc_id", "text"), path)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
