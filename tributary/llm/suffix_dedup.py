"""Suffix-array dedup with a logarithmic family of indexes.

Bytes of a text go when they lie in a 50-byte string that also starts in a document with a
smaller doc_id.

Which suffixes are indexed is chosen by content: every 50-byte window belongs to the place of the
smallest hash among its 16-byte substrings, its anchor, so equal windows have their anchors at the
same distance.  The windows of one anchor make a stretch of text; it is cut in two, so that all
windows of a part share 33 bytes, the part's core.

1. Hashes of cores, packed in arrays, are dealt out and sorted; a stretch whose core stands in one row
   alone cannot repeat and is left out.  Each task first combines what it has read itself, so of a core
   that very many rows share no more than one entry a task is dealt out.
2. The bytes of the stretches left are dealt out by core.  Each task takes its share in order of doc_id,
   in batches (``IndexFamily``): a batch gets a suffix array (the windows sorted by their bytes), is
   merge-scanned against the arrays of the levels before it, and windows not met before become a new
   level; levels of about equal size merge, so there are as many as the logarithm of the share.  A window
   goes when its 50 bytes, not a hash, were met in a smaller doc_id.  Matches are given back as
   intervals.  Equal stretches are combined before they are dealt out.
3. A core that more stretches share than ``hot`` is split by its next bytes: half of the windows share
   a longer core, down to single windows, whose smallest doc_id is found by a grouped minimum.

Defined results: null text has no bytes; null doc_ids are larger than all others; rows with the
same doc_id never remove each other's bytes; texts under 50 bytes lose nothing; long texts are read in
parts of bounded size that overlap; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, lean
from tributary.llm.pieces import slices
from tributary.llm.sharing import mixed, shared

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1
#: Distances of a window's start from its anchor, of the two parts of a stretch.
PARTS = ((0, SPREAD // 2), (SPREAD // 2 + 1, SPREAD - 1))
LAST = (1 << 63) - 1
#: Windows hashed at a time; stretches of a task that are combined before they are dealt out, and of a batch of the family.
WINDOWS, STRETCHES, BATCH = 1 << 17, 1 << 17, 1 << 14
#: Stretches of one core that a single task takes.
HOT = 1 << 18
#: Index families to each shuffle partition.
SHARES = 4
LOW = np.uint64(0xFFFFFFFF)
STRETCH = "row long, doc long, start int, stop int, low int, high int, piece binary"


class Text:
    """Texts one after another, with the eight bytes that follow each place as numbers."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts) + bytes(64)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begins = self.ends - [len(t) for t in texts]
        self.words = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        self.size = len(self.raw) - 64
        starts = np.zeros(self.size + 1, np.int8)
        enough = self.ends - self.begins >= LENGTH
        starts[self.begins[enough]] = 1
        starts[self.ends[enough] - LENGTH + 1] = -1
        self.valid = np.cumsum(starts[: self.size], dtype=np.int8).view(bool)

    def stretches(self):
        """(first window, last window, anchor) of each stretch, as places, in parts of bounded size."""
        for lo in range(0, self.size, WINDOWS):
            m = min(WINDOWS, self.size - lo)
            n = min(m + SPREAD - 1, len(self.words) - 8 - lo)
            h = self.words[lo : lo + n] * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h += self.words[lo + 8 : lo + 8 + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h &= ~LOW
            h |= np.arange(n, dtype=np.uint64)  # of equal hashes the first place counts
            least, width = h, 1
            while 2 * width <= SPREAD:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[:m], least[SPREAD - width : SPREAD - width + m])
            anchor, valid = (least & LOW).astype(np.int64), self.valid[lo : lo + len(least)]
            edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]), [True]])
            first, last = np.flatnonzero(edge[:-1] & valid), np.flatnonzero(edge[1:] & valid)
            if len(first):
                yield first + lo, last + lo, anchor[first] + lo

    def core(self, anchor: np.ndarray, low: int, high: int) -> np.ndarray:
        """Hash of the bytes that all windows share whose starts are ``low`` to ``high`` before the anchor."""
        start, length = anchor - low, LENGTH - (high - low)
        x = np.full(len(anchor), low * 64 + high + 1, np.uint64)
        for k in [*range(0, length - 8, 8), length - 8]:
            x = mixed(x ^ self.words[start + k]) + np.uint64(k)
        return x

    def parts(self):
        """(text, anchor within it, low, high, core) of the parts of all stretches."""
        for first, last, anchor in self.stretches():
            text = np.searchsorted(self.ends, first, side="right")
            low, high = anchor - last, anchor - first
            for a, b in PARTS:
                here = np.flatnonzero((low <= b) & (high >= a))
                t = text[here]
                yield t, anchor[here] - self.begins[t], np.maximum(low[here], a), np.minimum(high[here], b), self.core(anchor[here], a, b)


def place(anchor, low, high):
    """Anchor and distances in one number."""
    return (anchor.astype(np.uint64) << np.uint64(16)) | (low.astype(np.uint64) << np.uint64(8)) | high.astype(np.uint64)


def core_entries(batch: pa.RecordBatch):
    """(core, row, place) of the parts of stretches in a batch of rows and texts."""
    row = batch.column(0).to_numpy()
    for lo, texts in slices(batch.column(1).cast(pa.binary())):
        for text, anchor, low, high, core in Text([t or b"" for t in texts.to_pylist()]).parts():
            yield core, row[lo + text], place(anchor, low, high)


class Pieces:
    """Byte strings one after another, of at most ``LENGTH + SPREAD`` bytes each."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        self.raw, self.sizes = raw, sizes
        self.begins = np.cumsum(sizes) - sizes

    @classmethod
    def cut(cls, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Pieces:
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return cls(raw[at], sizes)

    @classmethod
    def of(cls, column: pa.Array) -> Pieces:
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return cls(np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64))

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        return cls(np.concatenate([p.raw for p in parts]), np.concatenate([p.sizes for p in parts]))

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces.cut(self.raw, self.begins[which], self.sizes[which])

    def column(self) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(self.raw.tobytes())])

    def first(self, doc: np.ndarray) -> np.ndarray:
        """For each piece the smallest document that has an equal one."""
        width = LENGTH + SPREAD
        words = np.zeros((len(doc), width + 1), np.uint8)
        words[:, :width][np.arange(width) < self.sizes[:, None]] = self.raw
        words[:, width] = self.sizes
        words = words.view(f"S{width + 1}").ravel()
        order = np.argsort(words, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], words[order][1:] != words[order][:-1]]))
        out = np.empty(len(doc), np.int64)
        out[order] = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.concatenate([begin, [len(doc)]])))
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All strings of ``LENGTH`` bytes, the piece of each and its place there."""
        n = self.sizes - LENGTH + 1
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        words = np.lib.stride_tricks.sliding_window_view(self.raw, LENGTH)[self.begins[of] + within]
        return np.ascontiguousarray(words).view(f"S{LENGTH}").ravel(), of, within


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each row."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(row):
        return row, start, stop
    rank = np.cumsum(np.concatenate([[False], row[1:] != row[:-1]])) << 32
    far = np.maximum.accumulate(rank | stop)
    begin = np.flatnonzero(np.concatenate([[True], (rank | start)[1:] > far[:-1]]))
    return row[begin], start[begin], (far & 0xFFFFFFFF)[np.concatenate([begin[1:], [len(row)]]) - 1]


def spans_batch(row, start, stop) -> pa.RecordBatch:
    row, start, stop = merged(row, start, stop)
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["row", "start", "stop"])


def stretches(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of STRETCH: the parts of stretches with their bytes, and without bytes intervals found in a smaller document already."""
    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            row, doc, start, low, high = (np.concatenate([h[k] for h in held]) for k in range(5))
            pieces = Pieces.joined([h[5] for h in held])
            gone = pieces.first(doc) < doc
            found = spans_batch(row[gone], start[gone], (start + pieces.sizes)[gone])
            n, rest = found.num_rows, np.flatnonzero(~gone)
            none = lambda t: pa.nulls(n, t)
            columns = [pa.concat_arrays(x) for x in (
                (found.column(0), pa.array(row[rest])),
                (none(pa.int64()), pa.array(doc[rest])),
                (found.column(1), pa.array(start[rest].astype(np.int32))),
                (found.column(2), pa.nulls(len(rest), pa.int32())),
                (none(pa.int32()), pa.array(low[rest].astype(np.int32))),
                (none(pa.int32()), pa.array(high[rest].astype(np.int32))),
                (none(pa.binary()), pieces.take(rest).column()),
            )]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc", "start", "stop", "low", "high", "piece"])

        for batch in batches:
            row, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, texts in slices(batch.column(2).cast(pa.binary())):
                ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
                found = batch.column(3).slice(lo, len(texts))
                at = found.flatten().to_numpy().view(np.uint64)
                text = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy())
                low, high = (at >> np.uint64(8) & np.uint64(255)).astype(np.int64), (at & np.uint64(255)).astype(np.int64)
                start = (at >> np.uint64(16)).astype(np.int64) - high
                begin = start + np.concatenate([[0], ends])[text]
                held.append((row[lo + text], doc[lo + text], start, low, high, Pieces.cut(raw, begin, LENGTH + high - low)))
                size += len(at)
                if size >= STRETCHES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    asked = places.groupBy("row").agg(F.collect_list("place").alias("places"))
    both = rows.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text").join(asked, "row")
    return both.select("row", "doc", "text", "places").mapInArrow(lean(run), STRETCH)


class IndexFamily:
    """Levels of sorted windows, each with the first document that has it; ``add`` takes batches in order of doc_id."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def first(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each window the smallest document so far that has it; new windows become a level."""
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        begin = np.flatnonzero(new)
        array, first = ranked[begin], np.minimum.reduceat(doc[order], begin)
        fresh = np.ones(len(array), bool)
        for level, docs in self.levels:
            at = np.searchsorted(level, array)
            at[at == len(level)] = 0
            hit = level[at] == array
            first[hit] = np.minimum(first[hit], docs[at[hit]])
            fresh &= ~hit
        if fresh.any():
            self.levels.append((array[fresh], first[fresh]))
            while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
                (words_, docs_), (level, docs) = self.levels.pop(), self.levels.pop()
                at = np.searchsorted(level, words_)
                self.levels.append((np.insert(level, at, words_), np.insert(docs, at, docs_)))
        out = np.empty(len(words), np.int64)
        out[order] = first[np.cumsum(new) - 1]
        return out

    def add(self, pieces: Pieces, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, from, to): the intervals of each piece that smaller documents have, in 50-byte strings."""
        whole = pieces.first(doc) < doc
        found = [(np.flatnonzero(whole), np.zeros(whole.sum(), np.int64), pieces.sizes[whole])]
        rest = np.flatnonzero(~whole)
        if len(rest):
            left = pieces.take(rest)
            words, of, within = left.windows()
            gone = self.first(words, doc[rest][of]) < doc[rest][of]
            before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
            start = np.flatnonzero(gone & (~before | (within == 0)))
            stop = np.flatnonzero(gone & (~after | (within == (left.sizes - LENGTH)[of])))
            found.append((rest[of[start]], within[start], within[stop] + LENGTH))
        return tuple(np.concatenate(x) for x in zip(*found))


def cores(items: DataFrame) -> DataFrame:
    """With ``core``, the hash of what all windows of a stretch share whose starts are ``a`` to ``b`` before the anchor."""
    a, b = F.col("a"), F.col("b")
    return items.withColumn("core", F.xxhash64(a, b, F.substring("piece", F.col("high") - a + 1, LENGTH - (b - a))))


def matches(items: DataFrame, partitions: int) -> DataFrame:
    """(row, start, stop) of what the index families find."""
    def run(batches):
        family, held, size = IndexFamily(), [], 0

        def take():
            row, doc, start = (np.concatenate([h[k] for h in held]) for k in range(3))
            piece, a, b = family.add(Pieces.joined([h[3] for h in held]), doc)
            return spans_batch(row[piece], start[piece] + a, start[piece] + b)

        for batch in batches:
            held.append((*(batch.column(k).to_numpy() for k in range(3)), Pieces.of(batch.column(3))))
            size += batch.num_rows
            if size >= BATCH:
                yield take()
                held, size = [], 0
        if size:
            yield take()

    share = F.pmod("core", F.lit(64 * partitions)).cast("int").alias("share")
    # a family holds all windows of its share, so shares are smaller than those of other shuffles
    dealt_out = items.select("row", "doc", "start", "piece", share).repartition(SHARES * partitions, "share").sortWithinPartitions("doc")
    return dealt_out.select("row", "doc", "start", "piece").mapInArrow(lean(run), "row long, start int, stop int")


def halves(items: DataFrame) -> DataFrame:
    """Stretches cut in two parts whose windows share more bytes."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    two = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b")))
    each = items.withColumn("part", F.explode(two)).withColumns({
        "a": F.col("part.a"), "b": F.col("part.b"), "l": F.greatest("low", "part.a"), "h": F.least("high", "part.b"),
    }).filter("l <= h")
    shift = F.col("high") - F.col("h")
    each = each.withColumns({"piece": F.substring("piece", shift + 1, LENGTH + F.col("h") - F.col("l")), "start": F.col("start") + shift})
    return cores(each.select("row", "doc", "start", F.col("l").alias("low"), F.col("h").alias("high"), "piece", "a", "b"))


def settled(items: DataFrame, partitions: int, scratch: Scratch, hot: int) -> DataFrame:
    """(row, start, stop) of all repeats among stretches; cores of more than ``hot`` stretches are split by their next bytes."""
    near = F.col("low") <= PARTS[0][1]
    bounds = {n: F.when(near, PARTS[0][k]).otherwise(PARTS[1][k]) for k, n in enumerate("ab")}
    items = cores(items.select("row", "doc", "start", "low", "high", "piece").withColumns(bounds))
    found, k = None, 0
    while True:
        crowded = scratch.write(items.groupBy("core").count().filter(F.col("count") > hot).select("core"), f"crowded{k}")
        if crowded.isEmpty():
            part = matches(items, partitions)
            return part if found is None else found.unionAll(part)
        part = matches(items.join(crowded, "core", "left_anti"), partitions)
        found = part if found is None else found.unionAll(part)
        more = items.join(crowded, "core", "left_semi")
        single = more.filter("a = b")
        first = single.groupBy("core", "piece").agg(F.min("doc").alias("first"))
        together = single.join(first, ["core", "piece"]).filter("first < doc")
        found = found.unionAll(together.select("row", "start", (F.col("start") + LENGTH).alias("stop")))
        items, k = scratch.write(halves(more.filter("a < b")), f"halves{k}"), k + 1


def spans_of(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, text) as a table, and (row, start, stop) of bytes to remove, overlapping ones included."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.write(rows, "rows", compression="zstd")
    long_enough = rows.filter(F.octet_length("text") >= LENGTH).select("row", "text")
    places = scratch.write(shared(long_enough, core_entries, partitions).select("row", "place"), "places")
    every = scratch.write(stretches(rows, places), "stretches", compression="zstd")
    scratch.drop("places")
    found = settled(every.filter(F.col("piece").isNotNull()), partitions, scratch, hot)
    spans = scratch.write(found.unionAll(every.filter(F.col("piece").isNull()).select("row", "start", "stop")), "spans")
    scratch.drop("stretches")
    return rows, spans


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (maximal and sorted: start, end) and kept, the bytes left."""
    rows, spans = spans_of(docs, Scratch(docs.sparkSession, "suffix"), hot)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch.column(1).cast(pa.binary())):
                found = batch.column(2).slice(lo, len(texts))
                sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy()
                start, stop = (pc.struct_field(found.flatten(), k).to_numpy() for k in range(2))
                text, start, stop = merged(np.repeat(np.arange(len(texts)), sizes), start, stop)
                upto = np.searchsorted(text, np.arange(len(texts) + 1))
                kept, raw = [], [t or b"" for t in texts.to_pylist()]
                for t, a, b in zip(raw, upto.tolist(), upto[1:].tolist()):
                    cuts = [0, *np.stack([start[a:b], stop[a:b]], axis=1).ravel().tolist(), len(t)]
                    kept.append(b"".join([t[x:y] for x, y in zip(cuts[::2], cuts[1::2])]) if a < b else t)
                spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array([len(t) for t in raw], pa.int64()), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spans), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    asked = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    both = rows.join(asked, "row", "left").select("doc_id", "text", "found")
    return both.mapInArrow(lean(run), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT w.doc_id, i FROM w JOIN f ON w.g = f.g AND f.m < w.doc_id),
y AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM x),
z AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM y),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM z GROUP BY doc_id, k),
p AS (SELECT s.doc_id, k, a, b, substr(h, CAST(2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY k), 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY k), 0)) AS BIGINT)) AS piece, h FROM s JOIN d ON d.doc_id = s.doc_id),
r AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY k) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(r.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
