"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of five-word shingles; two are linked when their Jaccard similarity is
at least 0.75.  Documents with equal sets form classes, and one row stands for each.
Signatures of 256 hashes are cut into bands; classes that share a band are candidates.
Candidates are compared batch by batch: after each batch of hashes a pair goes when the
posterior probability that it is similar falls under the chosen miss probability.  What
survives is verified on the full sets, so no link is wrong.

Groups are never expanded into pairs.  In a bucket the smallest member is compared with
the others; what is then in one component needs no further comparison.  Members of buckets
that still hold several components form clusters (what shares such a bucket), and a cluster
is compared in blocks: a task holds two blocks of members, one of them at least from outside
the cluster's largest component, compares their signatures as matrices, verifies what survives and is not linked yet, and returns only links that join
components.  No candidate is capped, and rows grow with members and blocks, not with pairs.

Defined results: null or empty texts have an empty set, are linked with nothing and stay;
texts of fewer than five words are one shingle; rows with equal sets are one class, whatever
their ids; null ids come last; an empty table gives an empty table; other columns are not read
(``deduplicate`` passes them through).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, given_back, lean
from tributary.llm.components import components
from tributary.llm.pieces import slices
from tributary.llm.sharing import mixed, shared


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.75
    words: int = 5
    hashes: int = 256
    #: 40 bands of 5 hashes, drawn among the 256: two documents at the bound share no band with a chance of about 2 in 100,000.
    bands: int = 40
    band_rows: int = 5
    batch: int = 32
    #: Posterior probability under which a pair is given up.
    miss: float = 1e-6
    seed: int = 11
    #: Members of a block of a cluster.
    block: int = 512


#: Bytes of A-Z to a-z and other white space to the blank.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; words are hashed once a batch."""
    plain = pa.array([(t or b"").translate(PLAIN) for t in texts.cast(pa.binary()).to_pylist()], pa.large_binary())
    lists = pc.split_pattern(plain, b" ")
    codes = lists.values.dictionary_encode()
    distinct = codes.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    is_word = np.fromiter((w != b"" for w in distinct), bool, len(distinct))
    index = codes.indices.to_numpy(zero_copy_only=False)
    keep = is_word[index] if len(index) else np.zeros(0, bool)
    words = hashes[index[keep]]
    ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy()]
    p = np.uint64(0x9E3779B97F4A7C15)
    rolled = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        rolled *= p
        rolled += words[k : len(words) - size + 1 + k]
    rolled = mixed(rolled)
    out = []
    for lo, hi in zip(ends, ends[1:]):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mixed(np.array([xxhash.xxh64_intdigest(words[lo:hi].tobytes(), seed=1)], np.uint64)))
        else:
            out.append(rolled[:0])
    return out


def permutations(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, 1 << 31, s.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    """The lower 16 bits of each least hash: unequal ones meet with a chance of 1 in 65,536."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        h = x[lo : lo + 1024] * a
        h += b
        np.minimum(out, h.min(axis=0), out=out)
    return out.astype("<u2")


def band_members(s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed + 1)
    return np.array([rng.choice(s.hashes, s.band_rows, replace=False) for _ in range(s.bands)])


def least_matches(s: Settings) -> list[int]:
    """For each number of batches, the matches under which P(similarity >= bound) is below the miss probability, with a flat prior."""
    x = (np.arange(20_000) + 0.5) / 20_000
    high = x >= s.similarity
    out = []
    for n in range(s.batch, s.hashes + 1, s.batch):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            weight = np.exp(log - log.max())
            if weight[high].sum() >= s.miss * weight.sum():
                out.append(m)
                break
    return out


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """Per row: doc_id, n_shingles, the 128-bit name of its set (k1, k2) and its signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        a, b = permutations(s)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                sets = shingle_sets(texts, s.words)
                names = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, len(texts)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([n[0] for n in names], pa.int64()),
                    pa.array([n[1] for n in names], pa.int64()),
                    pa.array([signature(x, a, b).tobytes() if len(x) else None for x in sets], pa.binary()),
                ], names=["doc_id", "n_shingles", "k1", "k2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, k1 long, k2 long, signature binary")


def banded(classes: DataFrame, s: Settings) -> DataFrame:
    """(bucket, c) of the classes in buckets of several classes."""
    def entries(batch):
        if batch.num_rows:
            pick = band_members(s)
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, s.hashes)
            key = np.tile(mixed(np.arange(1, s.bands + 1, dtype=np.uint64)), (len(rows), 1))
            for k in range(s.band_rows):
                key = mixed(key ^ rows[:, pick[:, k]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids = np.repeat(batch.column(0).to_numpy(), s.bands)
            yield key.ravel(), ids, np.zeros(len(ids), np.uint64)

    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared(classes.select("c", "signature"), entries, partitions, keyed=True).select(F.col("key").alias("bucket"), F.col("row").alias("c"))


def surviving(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that sequential comparison of signature batches does not give up."""
    def run(batches):
        least = least_matches(s)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, s.hashes) for k in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, int)
            for k, m in enumerate(least):
                part = slice(k * s.batch, (k + 1) * s.batch)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    sign = lambda c: classes.select(F.col("c").alias(c), F.col("signature").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    # similarity is at most the ratio of the sizes
    both = pairs.join(sign("a"), "a").join(sign("b"), "b").filter(F.least("na", "nb") >= s.similarity * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def full_sets(docs: DataFrame, needed: DataFrame, s: Settings) -> DataFrame:
    """(c, shingles) of the classes needed, from the text of the document that stands for each. ``needed``: c, doc_id, k1, k2."""
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                sets = [x for x in shingle_sets(texts, s.words) if len(x)]
                names = [np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["k1", "k2", "shingles"],
                )

    ids = needed.select(F.col("doc_id").alias("d")).distinct()
    # a sort-merge join at every size: the ids are too many to broadcast on large inputs, so what is measured on small ones holds
    texts = docs.hint("merge").join(ids, docs["doc_id"].eqNullSafe(ids["d"]), "left_semi").select("text")
    sets = texts.mapInArrow(lean(run), "k1 long, k2 long, shingles binary")
    # rows that share an id with the one needed, or its set, are told apart by the set's name; any one of a class will do
    return sets.join(needed.select("c", "k1", "k2"), ["k1", "k2"]).select("c", "shingles").dropDuplicates(["c"])


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose full sets are similar."""
    hundredths = round(100 * s.similarity)

    def run(batches):
        for batch in batches:
            ok = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= hundredths * (len(x) + len(y) - shared):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), batch.column(1).take(pa.array(ok, pa.int64()))], names=["a", "b"])

    of = lambda c: sets.select(F.col("c").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def block_links(left: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """Links (a, b) that join components among members that share an open bucket. ``left``: c, label, least (of its bucket)."""
    hundredths = round(100 * s.similarity)

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        least = least_matches(s)
        rows = rows.sort_values(["block", "c"], kind="stable").reset_index(drop=True)
        signs = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(len(rows), s.hashes)
        sets_ = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        size = np.array([len(x) for x in sets_])
        code = np.unique(np.concatenate(sets_), return_inverse=True)[1]
        codes, mark = np.split(code, np.cumsum(size)[:-1]), np.zeros(code.max() + 1, bool)
        c, top, block = rows["c"].to_numpy(), rows["label"].to_numpy().copy(), rows["block"].to_numpy()
        within = rows["lo"].iloc[0] == rows["hi"].iloc[0]
        out = []
        for i in range(len(rows)):
            other = np.arange(i + 1, len(rows)) if within else np.flatnonzero(block > block[i])
            other = other[(top[other] != top[i]) & (np.minimum(size[other], size[i]) >= s.similarity * np.maximum(size[other], size[i]))]
            got = np.zeros(len(other), int)
            for lo in range(0, s.hashes, s.batch):  # batch by batch, what the posterior gives up goes
                part = slice(lo, lo + s.batch)
                got = got + (signs[other, part] == signs[i, part]).sum(axis=1)
                alive = got >= least[lo // s.batch]
                other, got = other[alive], got[alive]
            mark[codes[i]] = True
            for j in other[np.argsort(-got, kind="stable")]:
                if top[j] == top[i]:
                    continue
                shared = np.count_nonzero(mark[codes[j]])
                if 100 * shared >= hundredths * (size[i] + size[j] - shared):
                    out.append((c[i], c[j]))
                    top[top == top[j]] = top[i]
            mark[codes[i]] = False
        given_back()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    ties = left.filter("c <> least").select(F.col("least").alias("a"), F.col("c").alias("b"))
    cluster = components(ties, scratch, "cluster")
    named = left.select("c", F.col("label").alias("component")).distinct()
    members = scratch.write(named.join(cluster, F.col("c") == F.col("node")).select("c", "component", F.col("label").alias("cluster")), "cluster-members")
    # members of a cluster's largest component are compared with the others only, and never with one another
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("m"), (F.sum("n") - F.max("n")).alias("r")).filter("r > 0")
    number = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    most = most.select("cluster", "main", number("r", s.block).alias("others"), number("m", 4 * s.block).alias("mains"))
    slot = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    main = F.col("component") == F.col("main")
    dealt = members.join(most, "cluster").withColumn("block", F.when(main, F.col("others") + slot("mains")).otherwise(slot("others")))
    dealt = dealt.withColumn("upto", F.col("others") - 1 + F.when(main, 0).otherwise(F.col("mains")))
    dealt = dealt.join(classes.select("c", "signature"), "c").join(sets, "c")
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("upto"))))
    dealt = dealt.select("cluster", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "c", F.col("component").alias("label"), "signature", "shingles")
    return dealt.groupBy("cluster", "lo", "hi").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, s: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, k1, k2 (the set's name) and component_id, the smallest doc_id that links reach."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows = scratch.write(sketch(docs, s), "sketch")
    full = rows.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = scratch.write(full.withColumn("c", F.monotonically_increasing_id()), "classes")
    rows = scratch.write(rows.drop("signature"), "names")
    scratch.drop("sketch")

    members = scratch.write(banded(classes, s), "bands")
    pivots = scratch.write(members.groupBy("bucket").agg(F.min("c").alias("pivot")), "pivots")
    members = scratch.write(members.join(pivots, "bucket"), "members")
    scratch.drop("bands")

    wanted = scratch.write(members.select("c").distinct().join(classes.select("c", "doc_id", "k1", "k2"), "c"), "wanted")
    sets = scratch.write(full_sets(docs, wanted, s), "sets")

    pairs = members.filter("c <> pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
    links = scratch.write(verified(surviving(pairs, classes, s), sets, s), "links")
    label = components(links, scratch, "label")
    # members left to compare: the pivot of a bucket has been, and members of one component need not be
    named = members.filter("c <> pivot").select("bucket", "c").join(label, F.col("c") == F.col("node"), "left")
    named = scratch.write(named.select("bucket", "c", F.coalesce("label", "c").alias("label")), "left")
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("c").alias("least")).filter("lo <> hi")
    left = scratch.write(named.join(several.select("bucket", "least"), "bucket").select("c", "label", "least").distinct(), "open")
    if not left.isEmpty():
        more = scratch.write(block_links(left, classes, sets, scratch, s), "block-links")
        links = links.unionAll(more)
        label = components(links, scratch, "label-all")
    named = classes.select("c", "doc_id", "k1", "k2").join(label, F.col("c") == F.col("node"), "left").select("c", "doc_id", "k1", "k2", F.coalesce("label", "c").alias("label"))
    named = scratch.write(named, "named")
    for done in ("sets", "members", "wanted", "left", "open", "classes", "cluster-members"):
        scratch.drop(done)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reach = scratch.write(named.join(least, "label").select("k1", "k2", "component_id"), "reach")
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(reach, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", "k1", "k2", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id, with its own columns. Of rows with that same id the first one stays."""
    scratch = Scratch(docs.sparkSession, "dedup")
    own = F.struct(F.lit(0).alias("pad"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]).alias("own")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), own)
    rows = scratch.write(rows, "rows")
    found = near_duplicates(rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("doc_id"), "text"), s, scratch)
    stays = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("row"))
    back = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return rows.join(stays, "row", "left_semi").select(*[(back[c] if c in back else F.col("own").getField(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, q.c AS component_id, d.doc_id = q.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q ON q.doc_id = d.doc_id
"""
