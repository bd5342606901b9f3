"""Personal data by bootstrapped contextual extraction, in built-in functions only.

Four kinds of identifiers with a checkable form (email, ip, card, phone) are the seeds.
The word before a seed and its general form make a lexical pattern.  Strings of such
forms that are no seeds are candidates: words with @ or with "at" written out, dotted
numbers, and digits in groups.  Patterns and strings form a graph: a
pattern is scored by the strings it takes up, a string by the patterns it stands in, and
the scores are exchanged for a fixed number of rounds over the whole corpus.  Candidates
in patterns that stay above a threshold are identifiers that no form check finds, such as
card numbers with a wrong check digit, phone numbers without the plus sign, dotted numbers
out of range, or addresses with "at" and "dot".

Positions are code points, ends exclusive.  Defined results: null text counts as empty;
rows are handled one by one, so repeated rows give repeated results and null ids pass
through; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, text_of

#: Forms of the base kinds, in listed order. A run of characters is entered at its start or where the last match ended, and
#: quantifiers are possessive: the same matches as without, in linear time and without recursion.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
KINDS = list(FORMS)
#: Strings that could be meant as one of the kinds: words with @, or "at" written out before a dotted name; runs of digit groups
#: with up to three signs between them, which take in dotted numbers.
AT = r"(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+"
    rf"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
    r"|(?<![\p{L}\p{N}])[(]?[0-9](?:[\x20().-]{0,3}+[0-9])*+(?![\p{L}\p{N}])"
)


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    #: Distinct seeds that a pattern needs, and the scores from which patterns and strings count.
    support: int = 5
    pattern_score: float = 0.8
    string_score: float = 0.8


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; for strings of up to 19 digits."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 1, F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda t, x: t + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    n = F.length(digits_of(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def holds(kind: str):
    return lambda m: valid(kind, m)


def of_kind(kind: Column):
    return lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


SPAN = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, form: str, ok, needs: str = "") -> Column:
    """Places of all matches that hold: the pieces between matches and the matches give running positions."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    empty = F.array().cast(SPAN)

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["m"])
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))))
        return F.struct(end.alias("at"), F.when(ok(x["m"]), more).otherwise(acc["out"]).alias("out"))

    def located(ms):
        pairs = F.zip_with(F.slice(F.split(text, form, -1), 1, F.size(ms)), ms, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    out = F.transform(F.array(found), lambda ms: F.when(F.exists(ms, ok), located(ms)).otherwise(empty))[0]
    return F.when(F.contains(text, F.lit(needs)), out).otherwise(empty) if needs else out


def shape(m: Column) -> Column:
    """The general form of a string: an address, a dotted number of four groups, or so many digits whatever stands between them."""
    dotted = m.rlike(r"^[^0-9]*[0-9]+(\.[0-9]+){3}[^0-9]*$")
    return F.when(m.rlike(rf"@|[^0-9()\[\]]{AT}|{AT}[A-Za-z]"), F.lit("a@a")).when(dotted, F.lit("9.9.9.9")).otherwise(F.concat(F.lit("9x"), F.length(digits_of(m))))


def possible(m: Column) -> Column:
    """Whether a seed can have the string's general form: no valid card or phone has fewer than 8 digits or more than 19."""
    return ~shape(m).startswith("9x") | F.length(digits_of(m)).between(8, 19)


def before(text: Column, start: Column) -> Column:
    """The word before a place, in lower case and without signs; empty at the start of a text."""
    left = F.substring(text, F.greatest(F.lit(1), start - 63), F.least(start, F.lit(64)))
    return F.regexp_replace(F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)), r"[^\p{L}\p{N}]", "")


def mentions(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per row: doc_id, a span array for each kind, and ``others``: strings with digits outside all seeds, with their contexts."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    rows = rows.withColumns({k: spans(F.col("text"), FORMS[k], holds(k), NEEDS[k]) for k in KINDS})
    seeds = F.concat(*[F.transform(k, of_kind(F.lit(k))) for k in KINDS])
    trim = lambda s: F.struct(
        (s["start"] + F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}]*", 0))).alias("start"),
        (s["end"] - F.length(F.regexp_extract(s["value"], r"[^\p{L}\p{N}]*$", 0))).alias("end"),
        F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("value"),
        s["start"].alias("word"),
    )
    rows = rows.withColumn("seeds", seeds).withColumn("found", spans(F.col("text"), CANDIDATE, possible))
    others = F.filter(F.transform("found", trim), lambda s: ~F.exists("seeds", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    context = lambda kind, at="start": lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), before(F.col("text"), s[at]).alias("left"), shape(s["value"]).alias("shape"))
    return rows.select(
        "doc_id", *KINDS,
        F.transform("seeds", context(lambda s: s["kind"])).alias("seeds"),
        F.transform(others, context(lambda s: F.lit(None).cast("string"), "word")).alias("others"),
    )


def grow(rows: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """High-confidence patterns (kind, left, shape, score) after the rounds over the pattern-string graph.

    Edges are distinct (pattern, string) pairs, so a string that stands in a third of all documents counts once a pattern.
    A pattern without the shape (only the word) would take up any number; one without the word any number of a shape.
    """
    seed = rows.select(F.explode("seeds").alias("s")).select("s.kind", "s.left", "s.shape", "s.value").distinct()
    other = rows.select(F.explode("others").alias("s")).select("s.left", "s.shape", "s.value").distinct()
    patterns = seed.groupBy("kind", "left", "shape").agg(F.count("*").alias("n_seeds")).filter(F.col("n_seeds") >= settings.support)
    patterns = scratch.write(patterns, "patterns")
    edges = scratch.write(other.join(patterns, ["left", "shape"]).select("kind", "left", "shape", "value"), "edges")
    # a string starts with nothing; a pattern's score is the mean over its strings, seeds counting 1
    strings = None
    scored = patterns.withColumn("score", F.lit(1.0))
    for k in range(settings.rounds):
        if strings is None:
            taken = edges.groupBy("kind", "left", "shape").agg(F.count("*").alias("n"), F.lit(0.0).alias("mass"))
        else:
            taken = edges.join(strings, ["kind", "value"]).groupBy("kind", "left", "shape").agg(F.count("*").alias("n"), F.sum("string_score").alias("mass"))
        scored = patterns.join(taken, ["kind", "left", "shape"], "left").select(
            "kind", "left", "shape", "n_seeds",
            ((F.col("n_seeds") + F.coalesce("mass", F.lit(0.0))) / (F.col("n_seeds") + F.coalesce("n", F.lit(0)))).alias("score"),
        )
        strings = edges.join(scored, ["kind", "left", "shape"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.ln(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("string_score"))
        strings = scratch.write(strings, f"strings{k}")
    best = scored.filter(F.col("score") >= settings.pattern_score)
    good = strings.filter(F.col("string_score") >= settings.string_score) if strings is not None else None
    return scratch.write(edges.join(best, ["kind", "left", "shape"]).join(good, ["kind", "value"]).select("kind", "left", "shape", "value", "score"), "discovered")


def extract(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, ``base`` and ``spans``, arrays of (kind, start, end, value), in the order of kinds and places."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.write(mentions(docs, settings).withColumn("row", F.monotonically_increasing_id()), "rows")
    discovered = grow(rows, settings, scratch)
    hit = rows.filter(F.size("others") > 0).select("row", F.explode("others").alias("s")).select("row", "s.start", "s.end", "s.value", "s.left", "s.shape")
    # a string can stand for several kinds; the best pattern decides, the listed order breaks ties
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    hit = hit.join(discovered, ["left", "shape", "value"]).groupBy("row", "start", "end", "value").agg(F.max_by(F.struct("kind"), F.struct(F.col("score"), -order)).alias("k"))
    more = hit.groupBy("row").agg(F.collect_list(F.struct(F.col("k.kind").alias("kind"), F.col("start"), F.col("end"), F.col("value"))).alias("more"))
    base = F.transform("seeds", lambda s: of_kind(s["kind"])(s))
    rows = rows.join(more, "row", "left").withColumn("base", base)
    every = F.concat("base", F.coalesce("more", F.array().cast(rows.schema["more"].dataType)))
    ranked = F.sort_array(F.transform(every, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s.alias("s"))))
    return rows.select("doc_id", "base", F.transform(ranked, lambda x: x["s"]).alias("spans"))


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts are those of the base kinds; ``base_sha256`` and ``spans`` as places ``kind:start:end``."""
    done = extract(docs.select("doc_id", "text"), settings)
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return done.select(
        "doc_id",
        *[F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
