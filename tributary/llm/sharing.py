"""Keys that stand in several rows, found without a row for each entry.

A task packs its entries (key, row, place) in arrays and combines what it has read itself: entries
whose key stands in several of its rows are shared for sure, and of such a key only a mark is dealt
out.  Marks and the other entries are dealt out by key, sorted, and those that share a key with
another row or a mark come back.  So a key that very many rows have costs an entry for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tributary.llm.common import lean

#: Entries of a task that are combined before they are dealt out.
ENTRIES = 1 << 20
#: The place of an entry that only says that a key stands in several rows; other places are smaller.
MARK = np.uint64((1 << 48) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def several(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where keys begin in it, and which of them stand in more than one row."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return order, begin, np.minimum.reduceat(row[order], begin) < np.maximum.reduceat(row[order], begin)


def spread(of_key: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What is said of keys, for each entry."""
    out = np.empty(len(order), of_key.dtype)
    out[order] = np.repeat(of_key, np.diff(np.concatenate([begin, [len(order)]])))
    return out


def planes(x: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of numbers, first all lowest ones, then all second ones."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").ravel()


def shared(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[tuple]], partitions: int, keyed: bool = False) -> DataFrame:
    """(key, row, place) of entries whose key stands in several rows.

    ``entries`` gives arrays of keys (64 bits), rows and places (under 48 bits) of a batch.  Unless ``keyed``, keys are
    compared by their partition and 48 bits, and those given back say nothing.
    """
    width = 8 if keyed else 6

    def dealt(batches):
        press, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def packed(part: int, known: bool, key, row, at):
            return part, known, press.compress(np.int64(len(key)).tobytes() + planes(key, width) * (keyed or not known) + planes(row, 8) + planes(at, 6))

        def flush():
            key, row, at = (np.concatenate(x) for x in zip(*held))
            order, begin, several_ = several(key, row)
            known, marks = spread(several_, order, begin), key[order[begin[several_]]]
            out = [packed(int(mixed(row[:1].view(np.uint64))[0] % np.uint64(partitions)), True, key[known], row[known], at[known])] if known.any() else []
            key, row, at = (np.concatenate([x[~known], y]) for x, y in ((key, marks), (row, np.zeros(len(marks), np.int64)), (at, np.full(len(marks), MARK))))
            to = (key >> np.uint64(48)) % np.uint64(partitions)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(partitions + 1))
            out += [packed(p, False, key[by[a:b]], row[by[a:b]], at[by[a:b]]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "known", "payload"])

        for batch in batches:
            for some in entries(batch):
                held.append(some)
                size += len(some[0])
                if size >= ENTRIES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def met(batches):
        tool, held = zstandard.ZstdDecompressor(), []

        def out(key, row, at):
            order = np.lexsort((at, row))
            for lo in range(0, len(order), ENTRIES):
                some = order[lo : lo + ENTRIES]
                yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (key, row, at)], names=["key", "row", "place"])

        for batch in batches:
            for known, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(tool.decompress(payload.as_buffer()), np.uint8)
                n = int(raw[:8].view("<i8")[0])
                has_key = keyed or not known
                key, row, at = np.split(raw[8:], np.cumsum([width * n * has_key, 8 * n]))
                key, row, at = from_planes(key, n, width) if has_key else np.zeros(n, np.uint64), from_planes(row, n, 8).view(np.int64), from_planes(at, n, 6)
                if known:
                    yield from out(key, row, at)
                else:
                    held.append((key, row, at))
        if held:
            key, row, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, begin, several_ = several(key, row)
            keep = spread(several_ | (np.maximum.reduceat(at[order], begin) == MARK), order, begin) & (at != MARK)
            yield from out(key[keep], row[keep], at[keep])

    packs = rows.mapInArrow(lean(dealt), "part int, known boolean, payload binary")
    return packs.repartition(partitions, "part").select("known", "payload").mapInArrow(lean(met), "key long, row long, place long")
