"""Line dedup by content-defined chunks of lines.

Each line has a 64-bit hash; a rolling hash over the last ``window`` line hashes says where
a chunk ends, so the same run of lines is cut alike wherever it stands in a document.
Chunks that occur before are found whole.  Around and across them the shortest runs of lines
that reach the thresholds are compared: from each line with a word the shortest run that begins
there and the shortest that ends there.  Every repeated run of ``min_words`` words and
``min_lines`` lines is the union of such short runs, so it goes whole, wherever chunks are cut
and whatever stands beside it, everywhere but at its first place (smallest doc_id, then place),
after its text has been compared with the text of that first place.

Runs within a chunk that occurs before are not looked at again; their first place is in the
first such chunk.  Only identifiers are counted and only repeated runs' texts are moved.

Defined results: null text stays null; lines are split at line feeds only; a run begins and ends
at lines with a word, so blank lines beside it stay; null ids come
last when the first place is chosen; rows with the same id and text are one place each, told
apart by their order in the input; a run whose hash is shared by another run is kept
unless its text equals the first place's; runs may overlap, also within a document, and of each
line that goes an equal one stays at an earlier place; the rest of the lines is joined by line feeds; an
empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, lean
from tributary.llm.pieces import slices

ITEM = "row long, doc_id {}, at int, n int, inside int, chunk boolean, h long"
TEXT = "h long, row long, at int, n int, is_first boolean, chunk binary"


def chunk_ends(lines: Column, window: int, divisor: int, max_lines: int) -> Column:
    """The number of lines up to the end of each chunk.

    A line ends a chunk when the rolling hash of it and the lines before it is divisible by ``divisor``; between two
    such ends every ``max_lines``-th line after the first of them does too, which bounds chunks of lines that are all alike.
    """

    def cut(ls: Column) -> Column:
        hashes = F.transform(ls, lambda x: F.xxhash64(x))
        marked = F.transform(F.array(hashes), lambda h: F.filter(
            F.transform(ls, lambda _, i: F.when((F.pmod(F.xxhash64(F.slice(h, F.greatest(F.lit(1), i + 2 - window), F.least(i + 1, F.lit(window)))), F.lit(divisor)) == 0) | (i + 1 == F.size(ls)), i + 1)),
            lambda e: e.isNotNull(),
        ))[0]
        return F.transform(F.array(marked), lambda ends: F.flatten(F.transform(ends, lambda e, k: bounded(
            F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)), e
        ))))[0]

    def bounded(start: Column, end: Column) -> Column:
        return F.when(end - start > max_lines, F.concat(F.sequence(start + max_lines, F.greatest(end - 1, start + max_lines), F.lit(max_lines)), F.array(end))).otherwise(F.array(end))

    return F.transform(F.array(lines), cut)[0]


def line_chunks(text: Column, window: int = 2, divisor: int = 3, max_lines: int = 64) -> Column:
    """The text as an array of chunks (``at``, ``n``, ``text``), in order; joined by line feeds they give the text."""
    lines = F.split(text, "\n", -1)
    both = F.struct(lines.alias("ls"), chunk_ends(lines, window, divisor, max_lines).alias("ends"))

    def parts(x: Column) -> Column:
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(x["ends"], k - 1))
        return F.transform(x["ends"], lambda e, k: F.struct(start(k).alias("at"), (e - start(k)).alias("n"), F.array_join(F.slice(x["ls"], start(k) + 1, e - start(k)), "\n").alias("text")))

    return F.transform(F.array(both), parts)[0]


def runs_of(counts: list[int], ends: list[int], min_lines: int, min_words: int) -> list[tuple[int, int, int, bool]]:
    """(at, n, inside, chunk) of what is compared in a document: its chunks without blank lines at their ends, and the
    shortest runs from and up to each line with a word; ``inside`` is the chunk that holds such a run, or -1."""
    filled = [i for i, c in enumerate(counts) if c]
    upto = [0]
    for c in counts:
        upto.append(upto[-1] + c)
    enough = lambda i, j: j - i + 1 >= min_lines and upto[j + 1] - upto[i] >= min_words
    out: dict[tuple[int, int], tuple[int, bool]] = {}
    holder: dict[int, tuple[int, int]] = {}
    k = 0
    for c, end in enumerate(ends):
        first = k
        while k < len(filled) and filled[k] < end:
            k += 1
        if k > first and enough(filled[first], filled[k - 1]):
            out[filled[first], filled[k - 1]] = (-1, True)
            for i in filled[first:k]:
                holder[i] = (c, filled[first])

    def add(i: int, j: int):
        if (i, j) not in out:
            same = i in holder and j in holder and holder[i][0] == holder[j][0]
            out[i, j] = (holder[i][1] if same else -1, False)

    k = 0
    for i in filled:
        while k < len(filled) and not enough(i, filled[k]):
            k += 1
        if k == len(filled):
            break
        add(i, filled[k])
    k = 0
    for j in filled:
        while enough(filled[k + 1], j) if k + 1 < len(filled) and filled[k + 1] <= j else False:
            k += 1
        if enough(filled[k], j):
            add(filled[k], j)
    return [(i, j - i + 1, inside, chunk) for (i, j), (inside, chunk) in out.items()]


def offsets(lines: list[bytes]) -> list[int]:
    """Where each line begins, and one past the end."""
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    return at


def repeated_runs(rows: DataFrame, min_lines: int, min_words: int, scratch: Scratch) -> DataFrame:
    """(row, at, n) of the runs of lines to remove. ``rows``: row, doc_id, text, ends."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def items(batches):
        for batch in batches:
            for lo, texts in slices(batch.column(2).cast(pa.binary())):
                row, ids, found = batch.column(0).slice(lo, len(texts)).to_pylist(), [], ([], [], [], [], [], [])
                for k, (whole, ends) in enumerate(zip(texts.to_pylist(), batch.column(3).slice(lo, len(texts)).to_pylist())):
                    if whole is None:
                        continue
                    lines = whole.split(b"\n")
                    at = offsets(lines)
                    for i, n, inside, chunk in runs_of([len(x.split()) for x in lines], ends, min_lines, min_words):
                        h = int.from_bytes(blake2b(whole[at[i] : at[i + n] - 1], digest_size=8).digest(), "little", signed=True)
                        ids.append(lo + k)
                        for column, x in zip(found, (row[k], i, n, inside, chunk, h)):
                            column.append(x)
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
                columns = [pa.array(x, t) for x, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays([columns[0], batch.column(1).take(pa.array(ids, pa.int64())), *columns[1:]], names=["row", "doc_id", "at", "n", "inside", "chunk", "h"])

    every = scratch.write(rows.mapInArrow(lean(items), ITEM.format(kind)), "items")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")

    def several(of: DataFrame, name: str) -> DataFrame:
        counted = of.select("h", place.alias("place")).groupBy("h").agg(F.count("*").alias("times"), F.min("place").alias("first"))
        firsts = scratch.write(counted.filter("times > 1").select("h", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), name)
        return of.hint("merge").join(firsts, "h").withColumn("is_first", (F.col("row") == F.col("first_row")) & (F.col("at") == F.col("first_at")))

    copies = several(every.filter("chunk"), "chunk_firsts").filter("NOT is_first").select("row", F.col("at").alias("inside"))
    rest = scratch.write(every.hint("merge").join(copies, ["row", "inside"], "left_anti"), "rest")
    scratch.drop("items")
    hits = several(rest, "firsts").groupBy("row").agg(F.collect_list(F.struct("h", "at", "n", "is_first")).alias("hits"))

    def texts(batches):
        for batch in batches:
            for lo, some in slices(batch.column(1).cast(pa.binary())):
                found = ([], [], [], [], [], [])
                for row, whole, hits in zip(batch.column(0).slice(lo, len(some)).to_pylist(), some.to_pylist(), batch.column(2).slice(lo, len(some)).to_pylist()):
                    at = offsets(whole.split(b"\n"))
                    for x in hits:
                        run = whole[at[x["at"]] : at[x["at"] + x["n"]] - 1]
                        for column, v in zip(found, (x["h"], row, x["at"], x["n"], x["is_first"], run)):
                            column.append(v)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types)], names=["h", "row", "at", "n", "is_first", "chunk"])

    # joins that move texts are sort-merge joins at every size, so what is measured on small inputs holds on large ones
    moved = scratch.write(rows.select("row", "text").hint("merge").join(hits, "row").mapInArrow(lean(texts), TEXT), "several")
    scratch.drop("rest")
    original = moved.filter("is_first").select("h", F.col("chunk").alias("original")).dropDuplicates(["h"])
    same = moved.filter("NOT is_first").hint("merge").join(original, "h").filter(F.col("chunk") == F.col("original"))
    return same.select("row", "at", "n")


def kept_parts(runs: DataFrame) -> DataFrame:
    """Per row: the parts of its lines that stay (the last one is open), and the number of lines that go."""
    def merged(batches):
        for batch in batches:
            parts, lost = [], []
            for found in batch.column(1).to_pylist():
                at, gone, keep = 0, 0, []
                for x in sorted(found, key=lambda x: x["at"]):
                    if x["at"] > at:
                        keep.append({"at": at, "n": x["at"] - at})
                    end = x["at"] + x["n"]
                    gone += max(0, end - max(at, x["at"]))
                    at = max(at, end)
                parts.append([*keep, {"at": at, "n": 2**30}])
                lost.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))), pa.array(lost, pa.int32())], names=["row", "parts", "lost"])

    listed = runs.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    return listed.mapInArrow(lean(merged), "row long, parts array<struct<at:int,n:int>>, lost int")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_lines: int = 1, min_words: int = 20, window: int = 2, divisor: int = 3, max_lines: int = 64, report: bool = False) -> DataFrame:
    """The rows with repeated runs of lines taken out of the text; with ``report``, doc_id, n_removed_lines and the new text only."""
    scratch = Scratch(docs.sparkSession, "lines")
    others = F.struct(F.lit(0).alias("pad"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (text_col, id_col)]).alias("others")
    rows = docs.select(others, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(rows, "rows")
    cut = rows.select("row", "doc_id", "text", chunk_ends(F.split("text", "\n", -1), window, divisor, max_lines).alias("ends"))
    gone = scratch.write(kept_parts(repeated_runs(cut, min_lines, min_words, scratch)), "gone")
    scratch.drop("several")
    out = rows.hint("merge").join(gone, "row", "left")
    left = F.transform(F.array(F.split("text", "\n", -1)), lambda ls: F.flatten(F.transform("parts", lambda p: F.slice(ls, p["at"] + 1, p["n"]))))[0]
    out = out.withColumns({
        "new": F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        "lost": F.coalesce("lost", F.lit(0)),
    })
    if report:
        return out.select("doc_id", F.col("lost").cast("long").alias("n_removed_lines"), "new")
    own = {text_col: F.col("new"), id_col: F.col("doc_id")}
    return out.select(*[(own[c] if c in own else F.col("others").getField(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: lines removed, characters left, and the digest of what is left."""
    return dedup_lines(docs.select("doc_id", "text"), report=True).select(
        "doc_id",
        "n_removed_lines",
        F.length(F.coalesce("new", F.lit(""))).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("new", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
