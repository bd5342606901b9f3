"""Token ids in binary files, compressed by Re-Pair grammars.

Documents are encoded with the `tokenizers` library in ascending order of doc_id, an end
id after each, and written in blocks of about ``block_ids`` ids.  Within a block pairs of
neighbouring ids are replaced by nonterminals, round after round, until no pair occurs 16 times;
no pair spans two documents, so each document is a range of the compressed sequence and can be
decoded alone.

A block (little-endian unsigned 32-bit integers) is: magic, version, first nonterminal, number
of rules, of symbols, of documents; left and right side of each rule; length of each rule's
expansion; symbols; for each document the end of its symbols and the number of its ids.
Blocks are rows (part, block, doc_ids, n_ids, payload) of a Parquet table, so files are
committed by Spark's writer and survive lost executors on any shared store.

Defined results: null text counts as empty and gives the end id alone; null doc_ids come
first; rows with the same doc_id are ordered by text; a long text makes a block of its own length; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, lean
from tributary.llm.pieces import ENCODED, WordEncoder, gathered, slices

MAGIC, VERSION, HEAD = 0x31475052, 1, 6
BLOCK_SCHEMA = "part int, block int, doc_ids array<long>, n_ids long, payload binary"


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer, plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()  # neither changes words of a-z
    last = np.zeros(whole.get_vocab_size(with_added_tokens=True), bool)
    last[[i for t, i in whole.get_vocab().items() if t.endswith(whole.model.end_of_word_suffix)]] = True
    return WordEncoder(whole, plain, last)


def sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys and the keys in it; sorting them with their places in the low bits is the faster way where both fit."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 64:
        order = np.argsort(keys)
        return order, keys[order]
    both = np.sort((keys << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)


def frequent(place: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(pairs, n, place, which, counts): pairs that occur at least ``least`` times without overlap, how often, the places of each, and which of them count.

    ``keys`` are the pairs at ``place``; of a pair that repeats itself in a row every second place counts.
    """
    if len(keys) > 1 << 16:  # counting by hash first leaves only pairs that can be frequent to be sorted
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int32)
        can = np.bincount(slot, minlength=1 << 19)[slot] >= least
        place, keys = place[can], keys[can]
    same = np.concatenate([[False], (np.diff(place) == 1) & (keys[1:] == keys[:-1])]) if len(keys) else np.zeros(0, bool)
    counts = ~same
    if same.any():
        begin, again = np.flatnonzero(~same), np.flatnonzero(same)
        counts[again] = (again - begin[np.searchsorted(begin, again) - 1]) & 1 == 0
    order, ranked = sorted_keys(keys)
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    n = np.bincount(group[counts], minlength=int(new.sum()))
    often = n >= least
    here = often[group]
    return ranked[new][often], n[often], place[here], (np.cumsum(often) - 1)[group[here]], counts[here]


def chosen(place: np.ndarray, which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which places are replaced: where two overlap, the one of the more frequent pair."""
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    rank, beside = rank[which], np.diff(place) == 1
    return ~(np.concatenate([[False], beside & (rank[:-1] < rank[1:])]) | np.concatenate([beside & (rank[1:] < rank[:-1]), [False]]))


LOOK, END = 1, 2


def compress(seq: np.ndarray, ends: np.ndarray, first: int, least: int = 16):
    """Rules (n, 2) and their expansion lengths, the compressed sequence, and where documents end in it.

    Each round replaces all pairs that occur ``least`` times, the more frequent one where two overlap; pairs that lose too
    many places to others wait for the next round.  It ends when no pair occurs ``least`` times.  After the first round only
    pairs with a new symbol, and places that lost, can be frequent.
    """
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.ones(first, np.int64)
    seq = seq.astype(np.uint32)
    # of each symbol: whether its pair with the next one may be frequent, and whether it is the last of a document
    state = np.full(len(seq), LOOK, np.uint8)
    state[ends - 1] = END
    while True:
        place = np.flatnonzero(state == LOOK)  # no pair spans two documents
        width = (len(lengths) - 1).bit_length()  # bits of a symbol
        keys = (seq[place].astype(np.uint64) << np.uint64(width)) | seq[place + 1]
        pairs, n, near, which, counts = frequent(place, keys, least)
        if not len(pairs):
            return np.concatenate(rules), lengths[first:], seq, np.flatnonzero(state & END) + 1
        state[place] = 0
        state[near] = LOOK
        near, which = near[counts], which[counts]
        take = chosen(near, which, n)
        used = np.bincount(which[take], minlength=len(pairs)) >= least
        take &= used[which]
        place, which, base = near[take], (np.cumsum(used) - 1)[which[take]], len(lengths)
        sides = np.stack([pairs[used] >> np.uint64(width), pairs[used] & np.uint64((1 << width) - 1)], axis=1).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[sides].sum(axis=1)])
        rules.append(sides)
        seq[place] = (base + which).astype(np.uint32)
        # the new symbol ends a document if its right side did; else its pairs are new
        state[place] = LOOK | state[place + 1] & END
        state[np.maximum(place - 1, 0)] |= LOOK
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        # a pair before a removed symbol is one before the symbol that follows it
        seq, state = seq[stay], state[stay]


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of a range of symbols."""
    while True:
        inner = seq >= first
        if not inner.any():
            return seq
        size = np.where(inner, 2, 1)
        at = (np.cumsum(size) - size)[inner]
        sides = rules[seq[inner] - first]
        seq = np.repeat(seq, size)
        seq[at], seq[at + 1] = sides[:, 0], sides[:, 1]


def pack(ids: np.ndarray, ends: np.ndarray, first: int, **settings) -> bytes:
    rules, lengths, seq, at = compress(ids, ends, first, **settings)
    head = np.array([MAGIC, VERSION, first, len(rules), len(seq), len(ends)], "<u4")
    counts = np.diff(ends, prepend=0)
    return b"".join(np.ascontiguousarray(x, dtype="<u4").tobytes() for x in (head, rules[:, 0], rules[:, 1], lengths, seq, at, counts))


class Block:
    """A block read back; ``doc(i)`` and ``ids(i, lo, hi)`` decode no more than they return needs."""

    def __init__(self, payload: bytes):
        data = np.frombuffer(payload, "<u4")
        magic, version, self.first, n_rules, n_seq, n_docs = (int(x) for x in data[:HEAD])
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a block of token ids")
        left, right, self.lengths, self.seq, self.ends, self.counts = np.split(data[HEAD:], np.cumsum([n_rules, n_rules, n_rules, n_seq, n_docs]))
        self.rules = np.stack([left, right], axis=1)

    def _symbols(self, i: int) -> np.ndarray:
        return self.seq[(self.ends[i - 1] if i else 0) : self.ends[i]]

    def doc(self, i: int) -> np.ndarray:
        return expand(self._symbols(i), self.rules, self.first)

    def ids(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of a document: expansion lengths say which symbols hold them."""
        symbols = self._symbols(i)
        size = np.where(symbols < self.first, 1, self.lengths[np.maximum(symbols, self.first) - self.first] if len(self.lengths) else 1)
        upto = np.cumsum(size)
        a, b = np.searchsorted(upto, lo, side="right"), np.searchsorted(upto, hi, side="left") + 1
        skip = lo - (int(upto[a - 1]) if a else 0)
        return expand(symbols[a:b], self.rules, self.first)[skip : skip + hi - lo]

    def all(self) -> np.ndarray:
        """Ids of all documents: each rule is expanded once, by rules before it."""
        made = [b""] * len(self.rules)
        whole = lambda x: made[x - self.first] if x >= self.first else x.to_bytes(4, "little")
        for k, (left, right) in enumerate(self.rules.tolist()):
            made[k] = whole(left) + whole(right)
        pool = np.concatenate([np.arange(self.first, dtype="<u4"), np.frombuffer(b"".join(made), "<u4")])
        size = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        return gathered(pool, (np.cumsum(size) - size)[self.seq], size[self.seq])


def blocks(docs: DataFrame, path: str, end_id: int = 1, block_ids: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Rows of BLOCK_SCHEMA in ascending order of doc_id: parts are ranges of it, blocks follow one another in a part."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder = encoder_of(path)
        first = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        part, block, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            ids = np.concatenate([x for x, _ in held])
            ends = np.cumsum(np.concatenate([c for _, c in held]))
            payload = pack(ids, ends, first)
            doc_ids = pa.array([sum((n.to_pylist() for n in names), [])], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), doc_ids, pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            for lo, texts in slices(batch.column(1), ENCODED):
                ids, ends = encoder.encode(texts)
                ids = np.insert(ids, ends, np.uint32(end_id))
                held.append((ids, np.diff(ends, prepend=0) + 1))
                names.append(batch.column(0).slice(lo, len(texts)))
                size += len(ids)
                if size >= block_ids:
                    yield out()
                    block, held, names, size = block + 1, [], [], 0
        if held:
            yield out()

    return ranged.mapInArrow(lean(run), BLOCK_SCHEMA)


def block_starts(table: DataFrame) -> DataFrame:
    """(part, block, start): ids of all blocks before, summed within parts and then over parts, of which there is one row each."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.select("part", "block", "n_ids")
    within = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("outer", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)))
    return within.join(parts.select("part", "outer"), "part").select("part", "block", (F.col("inner") + F.col("outer")).alias("start"))


#: Row groups of a few blocks, so that a reader holds no more than that; sizes are checked after each block.
GROUPS = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def write(docs: DataFrame, path: str, out: str, **settings) -> DataFrame:
    blocks(docs, path, **settings).write.mode("overwrite").options(**GROUPS).parquet(out)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(out)


def read_back(table: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32 of its ids.

    Blocks are decoded where they are read; only a short row of each document meets the starts of blocks.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(3)[i].as_buffer())
                ids = np.ascontiguousarray(block.all(), dtype="<u4")
                counts = block.counts.astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                place = [pa.array(np.full(len(counts), batch.column(k)[i].as_py(), np.int32)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*place, batch.column(2).slice(i, 1).flatten(), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = table.select("part", "block", "doc_ids", "payload").mapInArrow(lean(run), "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(block_starts(table), ["part", "block"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, path: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_back(write(docs, path, f"{scratch.root}/blocks"))
