"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

``encode`` gives each document's ids and where each token starts, in bytes and in
characters; ``decode`` turns ids back into bytes by the reversed byte table.  A
character whose bytes are split over tokens is attributed to every token that holds
one of its bytes, and decoding joins the bytes before it reads characters.

Defined results: null text counts as empty (no ids, empty bytes); rows are handled one
by one, so repeated rows and null ids pass through; long texts are encoded whole, each in a
part of its own; only the named columns are read, so other columns can have any name; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import lean
from tributary.llm.pieces import ENCODED, ByteEncoder, gathered, slices


#: Ids that are decoded at a time, unless one row has more.
DECODED = 1 << 19


def byte_table() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def shown_tokens(path: str) -> list[str]:
    """Tokens in the order of their ranks, a character for each byte."""
    table = byte_table()
    return ["".join(table[b] for b in t) for t in read_ranks(path)]


@lru_cache(maxsize=4)
def tokenizer_of(path: str, pattern: str):
    """A `tokenizers` model that merges by ranks: every split of a token into two tokens is a merge of its rank."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown = shown_tokens(path)
    vocab = {s: i for i, s in enumerate(shown)}
    merges = []
    for s in shown:
        pairs = [(s[:k], s[k:]) for k in range(1, len(s)) if s[:k] in vocab and s[k:] in vocab]
        merges += sorted(pairs, key=lambda p: (vocab[p[0]], vocab[p[1]]))
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return out


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    """By id: its bytes, from the token's characters by the reversed byte table, and their number."""
    back = {c: b for b, c in byte_table().items()}
    out = [bytes(back[c] for c in shown) for shown in shown_tokens(path)]
    return out, np.array([len(t) for t in out], dtype=np.int64)


@lru_cache(maxsize=4)
def encoder_of(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(tokenizer_of(path, pattern), token_bytes(path)[1])


def starts(ids: np.ndarray, ends: np.ndarray, texts: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte and the character of its text at which each token starts, and whether that is inside the character.

    A token that starts inside a character gets that character's number. ``ends``: of each text's ids.
    """
    raw = np.frombuffer(b"".join([t or b"" for t in texts.cast(pa.binary()).to_pylist()]), np.uint8)
    lead = (raw & 0xC0) != 0x80
    number = np.cumsum(lead, dtype=np.int32) - 1
    at = np.cumsum(sizes[ids]) - sizes[ids]
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    begin = np.repeat(np.cumsum(lengths) - lengths, np.diff(ends, prepend=0))
    return at - begin, number[at] - number[begin], ~lead[at]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Per row: the id column, ``ids`` and, with offsets, ``byte_starts``, ``char_starts`` and ``n_inside``, the tokens that start inside a character.

    Texts are the rows of Arrow batches; a few megabytes are encoded at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("ids", "array<int>")] + [("byte_starts", "array<int>"), ("char_starts", "array<int>"), ("n_inside", "long")] * offsets

    def run(batches):
        encoder, sizes = encoder_of(path, pattern), token_bytes(path)[1]
        for batch in batches:
            for lo, texts in slices(batch.column(1), ENCODED):
                ids, ends = encoder.encode(texts)
                upto = np.concatenate([[0], ends])
                at = pa.array(upto, pa.int32())
                listed = lambda x: pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))
                columns = [batch.column(0).slice(lo, len(texts)), listed(ids)]
                if offsets:
                    *places, inside = starts(ids, ends, texts, sizes)
                    total = np.concatenate([[0], np.cumsum(inside)])
                    columns += [*map(listed, places), pa.array(np.diff(total[upto]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *[n for n, _ in fields]])

    schema = ", ".join([f"`{id_col}` {kind}", *[f"{n} {t}" for n, t in fields]])
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Per row: the columns to keep, ``ids_col`` and ``decoded``, the bytes that the ids stand for. Null ids decode to no bytes."""
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in [*keep, ids_col])

    def run(batches):
        tokens, sizes = token_bytes(path)
        pool, begins = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(len(keep))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            group = (np.cumsum(n) - n) // DECODED
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                ids = part.column(len(keep)).flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(n[lo:hi])])]
                raw = gathered(pool, begins[ids], sizes[ids])
                out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], names=[*keep, ids_col, "decoded"])

    return encoded.select(*keep, ids_col).mapInArrow(lean(run), f"{schema}, decoded binary")


def decode_text(ids, path: str) -> str:
    """Text of one id list; bytes that make no character become U+FFFD."""
    tokens = token_bytes(path)[0]
    return b"".join(tokens[i] for i in ids).decode("utf-8", errors="replace")


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, n_inside, and the digest of the bytes decoded from the ids."""
    done = decode(encode(docs, path, pattern), path, ["doc_id", "n_inside"])
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "n_inside", F.sha2("decoded", 256).alias("decoded_sha256"))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the decimal ids and of the decoded bytes, and tokens that start inside a character."""
    done = decode(encode(docs, path, pattern), path, ["doc_id", "n_inside"])
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_inside",
    )
