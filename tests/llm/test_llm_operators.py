"""Corpus operators against brute force on small tables with odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tributary.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, near_dedup, pii, quality, suffix_dedup, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
PROSE = "the quick brown fox and the lazy dog went to the river of stones in a warm and quiet morning while birds sang"
BASE = [f"w{i * 7919 % 1009}" for i in range(60)]
TEXTS = [
    None, "", " ", "a", "one two three", PROSE, PROSE.upper(), PROSE, " ".join(BASE), " ".join(BASE[:-2] + ["x", "y"]), " ".join(BASE[2:]),
    "  a  b\n \n c\t d   e  ", "\r\n\x1c x", "日本語 テキスト 😀😀 é", "Straße ÉCOLE J̌X İi Σς", "'s can't we'll<|endoftext|> x", "x" * 3000, " " * 200,
    "mail a@b.com_x@c.org, é😀 z@y.co. 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 555-1234", "4111 1111 1111 1111, 4111111111111112 00255.1.1.1 a@@b.c",
    "line one here\nline two here\n" * 30, "**** #### $$$$ %%%%", f"{PROSE}\n{PROSE}", "word " * 400, (PROSE + " " + " ".join(BASE)) * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "zz", None if i % 7 == 0 else f"s{i % 3}", i, i) for i, t in enumerate(TEXTS)] + [(None, PROSE, "zz", "s1", 1, 1), (5, PROSE, "zz", "s1", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long").repartition(3).cache()


@pytest.fixture(scope="module")
def unique(docs):
    """Rows told apart by their id."""
    return docs.filter("doc_id IS NOT NULL AND NOT (doc_id = 5 AND size = 1)")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_bpe_as_tiktoken(docs, unique):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    got = by_id(bpe.digest(unique, RANKS, P.PATTERN))
    for i, t in texts(unique).items():
        ids = own.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digest(docs, RANKS, P.PATTERN).count() == len(TEXTS) + 2
    assert bpe.digest(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_offsets_and_split_characters(unique):
    for r in bpe.encode(unique, RANKS, P.PATTERN).collect():
        assert r["n_inside"] <= max(0, len(r["ids"]) - 1)
        text = texts(unique.filter(f"doc_id = {r['doc_id']}"))[r["doc_id"]]
        raw = text.encode()
        ends = [*r["byte_starts"][1:], len(raw)]
        for i, a, b, c in zip(r["ids"], r["byte_starts"], ends, r["char_starts"]):
            assert bpe.token_bytes(RANKS)[0][i] == raw[a:b] and len(raw[:a].decode(errors="ignore")) == c
        assert bpe.decode_text(r["ids"], RANKS) == text


LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and sum(LUHN[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(unique):
    got = by_id(pii.digest(unique))
    for i, t in texts(unique).items():
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
    assert got[18]["n_email"] == 3 and got[18]["n_ip"] == 2 and got[18]["n_phone"] == 1 and got[19]["n_card"] == 1


def test_pii_discovers_from_contexts(spark):
    seeds = [(i, f"my card {4539148803436000 + i} is") for i in range(2000)]
    rows = [(i, t) for i, t in seeds if base_spans(t)][:120] + [(9000, "my card 4539148803436468 is"), (9001, "room 4539148803436468 is")]
    got = by_id(pii.digest(spark.createDataFrame(rows, "doc_id long, text string"), pii.Settings(rounds=2)))
    assert got[9000]["spans"] == "card:8:24" and got[9000]["n_card"] == 0
    assert got[9001]["spans"] == ""
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_discovers_general_forms(spark):
    cards = [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in (str(4539148803436000 + i) for i in range(900)) if base_spans(c)][:60]
    rows = [f"pay {c} now" for c in cards]
    rows += [f"call +1 (555) 010-{1000 + k} today" for k in range(60)] + [f"mail ann.lee@h{chr(97 + k % 26)}{chr(97 + k // 26)}.example soon" for k in range(60)] + [f"host 10.0.{k}.7 up" for k in range(60)]
    hidden = {"pay 4539 1488 0343 6468 now": "card:4:23", "call 1 (555) 010-2222 today": "phone:5:21", "call (1555) 010-2222 today": "phone:6:20", "mail bob at example.org soon": "email:5:23", "mail bob(at)example.org soon": "email:5:23", "host 9.9.300.1 up": "ip:5:14", "room 1 (555) 010-2222 today": "", "look at example.org soon": "", "version 9.9.300.1 up": "", "call 12 today": ""}
    rows += list(hidden)
    got = by_id(pii.digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert {rows[i]: got[i]["spans"] for i in range(240, len(rows))} == hidden


def test_quality_counts(unique, docs):
    got = by_id(quality.digest(unique))
    for i, t in texts(unique).items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
    assert got[5]["kept"] and not got[23]["kept"]
    assert quality.quality_filter(docs).columns == docs.columns and quality.quality_filter(docs.limit(0)).count() == 0


def test_exact_dedup(docs, unique, monkeypatch):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    want: dict = {}
    for i, t in texts(unique).items():
        want.setdefault(lower(t), []).append(i)
    got = by_id(exact_dedup.groups(unique))
    for i, t in texts(unique).items():
        group = want[lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(group), len(group), i == max(group), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.groups(docs).count() == len(TEXTS) + 2 and exact_dedup.groups(docs.limit(0)).count() == 0


def test_exact_dedup_when_identifiers_collide(unique, monkeypatch):
    from pyspark.sql import functions as F

    real = by_id(exact_dedup.groups(unique))
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    # every chunk has one identifier, so recipes of as many chunks are alike but for the digest of their texts
    assert by_id(exact_dedup.groups(unique)) == real


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    for _ in range(20):
        ids = rng.integers(0, int(rng.integers(2, 9)), int(rng.integers(1, 3000))).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 5), len(ids)))
        rules, lengths, seq, at = token_files.compress(ids, ends, 10, least=4)
        assert (token_files.expand(seq, rules, 10) == ids).all()
        full = np.concatenate([np.ones(10, np.int64), lengths])
        assert (np.add.reduceat(full[seq], np.concatenate([[0], at[:-1]])) == np.diff(ends, prepend=0)).all()
        counts, last = Counter(), None
        for a, b in zip([0, *at[:-1].tolist()], at.tolist()):
            for i in range(a, b - 1):
                pair = int(seq[i]), int(seq[i + 1])
                last = None if last == (i - 1, pair) else (i, pair)
                counts[pair] += last is not None
        assert max(counts.values(), default=0) < 4


def test_token_files(unique, docs):
    model = Tokenizer.from_file(WORDS)
    got, start = by_id(token_files.digest(unique, WORDS)), 0
    for i, t in sorted(texts(unique).items()):
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.digest(docs, WORDS).count() == len(TEXTS) + 2 and token_files.digest(docs.limit(0), WORDS).count() == 0


def test_re_pair_random_access():
    ids = np.random.default_rng(1).integers(0, 9, 5000).astype(np.uint32)
    ends = np.array([10, 11, 3000, 5000])
    block = token_files.Block(token_files.pack(ids, ends, 100))
    assert (block.all() == ids).all() and len(block.seq) < 3500
    assert all((block.ids(2, k, k + 50) == ids[11 + k : 61 + k]).all() for k in range(0, 2900, 13)) and block.doc(1).tolist() == ids[10:11].tolist()


def test_line_dedup(spark, docs):
    run = "\n".join(f"shared line number {i} of a long passage with many words" for i in range(12))
    rows = [(i, "\n".join(f"own line {i} {k} with words" for k in range(9)) + "\n" + run + f"\nend of {i}") for i in range(4)]
    got = by_id(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0]["n_removed_lines"] == 0 and all(got[i]["n_removed_lines"] >= 6 for i in (1, 2, 3))
    kept = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(f"own line {i} 0" in kept[i]["text"] and set(kept[i]["text"].split("\n")) <= set(dict(rows)[i].split("\n")) for i in range(4))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) + 2 and line_dedup.dedup_lines(docs.limit(0)).count() == 0
    joined = docs.select("doc_id", "text", line_dedup.line_chunks(docs["text"]).alias("c")).filter("text IS NOT NULL").collect()
    assert all("\n".join(x["text"] for x in r["c"]) == r["text"] for r in joined)


def repeated_lines(rows, min_words=20):
    """Lines of runs that stand at an earlier place too, from each pair of places."""
    places = [(i, k, x) for i in sorted(rows) for k, x in enumerate(rows[i].split("\n"))]
    gone = set()
    for b in range(len(places)):
        for a in range(b):
            n = 0
            while b + n < len(places) and places[a + n][0] == places[a][0] and places[b + n][0] == places[b][0] and places[a + n][2] == places[b + n][2]:
                n += 1
            run = [x[2] for x in places[b : b + n]]
            while run and not run[-1].strip():
                run.pop()
            skip = next((k for k, x in enumerate(run) if x.strip()), len(run))
            if sum(len(x.split()) for x in run) >= min_words:
                gone |= {(places[b + k][0], places[b + k][1]) for k in range(skip, len(run))}
    return gone


def test_line_dedup_takes_whole_runs(spark):
    rng = np.random.default_rng(8)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, runs = line(55), [[line(rng.integers(3, 9)) if k % 4 else "" for k in range(12)] for _ in range(4)]
    rows = {}
    for i in range(24):
        run = runs[i % 4]
        a, b = sorted(rng.integers(0, 13, 2))
        own = lambda: [line(rng.integers(1, 9)) for _ in range(rng.integers(1, 80 if i == 7 else 6))]
        rows[i] = "\n".join([*own(), *run[a:b], *own(), *([passage] if i % 3 == 0 else []), *own(), *(["same"] * 150 if i % 12 == 0 else [])])
    gone = repeated_lines(rows)
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)))
    assert {i: r["text"] for i, r in got.items()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows.items()}
    assert sum(passage in r["text"] for r in got.values()) == 1


def test_line_chunks_are_bounded_from_content(spark):
    tail = ["same"] * 200 + ["end of it"]
    texts = ["\n".join(["a b", "c d", "e f"][:k] + tail) for k in (1, 2, 3)]
    cut = spark.createDataFrame([(t,) for t in texts], "text string")
    ends = [[c["text"] for c in r["c"]] for r in cut.select(line_dedup.line_chunks(cut["text"], divisor=10**9).alias("c")).collect()]
    assert all(max(x.count("\n") + 1 for x in c) == 64 and "\n".join(c) == t for c, t in zip(ends, texts))


def test_mixing(spark, docs):
    rows = spark.createDataFrame([(i, "word " * (1 + i % 23), None if i % 3 == 0 else "ab"[i % 2] if i % 5 else "a") for i in range(600)], "doc_id long, text string, source string")
    got = mixing.digest(rows).collect()
    total, taken = {}, {}
    source = {r["doc_id"]: r["source"] for r in rows.collect()}
    for r in got:
        s = source[r["doc_id"]]
        total[s] = r["target"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
    assert abs(sum(total.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert all(abs(total[s] - taken[s]) <= 24 for s in total)
    assert sorted(map(tuple, mixing.digest(rows.repartition(5)).collect())) == sorted(map(tuple, got))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_pairing_keeps_the_words():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 400).astype(float), rng.random(400)
    out = mixing.pair_up(size, p, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 1 and abs((size * out).sum() - (size * p).sum()) < 1e-6


def components_of(rows):
    sets = {}
    for i, t in rows.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = [x for x in re.split("[\x20\x09-\x0d]+", w) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sets, {i: find(i) for i in rows}


def test_near_dedup(spark, unique, docs):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    many = {1000 + k: " ".join(w if rng.random() > 0.02 * (k % 5) else "zz" for w in base) for k in range(80)}
    rows = texts(unique) | many
    got = by_id(near_dedup.digest(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)))
    sets, top = components_of(rows)
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in rows} == {i: (len(sets[i]), top[i]) for i in rows}
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.filter(f"text = '{PROSE}'").count() <= 1 and near_dedup.deduplicate(docs.limit(0)).count() == 0


def removed(rows, n=50):
    seen, out = {}, {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen.setdefault(b[k : k + n], i) < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, unique, docs):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words, 60))
    more = {2000 + k: " ".join(rng.choice(words, 30)) + passage[k : 150 + 3 * k] + " ".join(rng.choice(words, 30)) for k in range(40)}
    rows = texts(unique) | more | {3000: "ab" * 400, 3001: "ba" * 300, 3002: "a" * 500, 3003: "a" * 49}
    got = by_id(suffix_dedup.digest(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == removed(rows)
    assert suffix_dedup.digest(docs).count() == len(TEXTS) + 2 and suffix_dedup.digest(docs.limit(0)).count() == 0


def test_suffix_dedup_splits_hot_cores_and_reads_long_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    passage, long = " ".join(rng.choice(words, 25)), " ".join(rng.choice(words, 250_000))
    rows = {k: " ".join(rng.choice(words, 12)) + passage + " ".join(rng.choice(words, 12)) for k in range(40)} | {100: long, 101: long[400_000:400_900], 102: passage}
    docs = spark.createDataFrame([*rows.items(), (None, passage), (None, passage), (7, passage)], "doc_id long, text string").repartition(3)
    whole, split = ({(r["doc_id"], r["n_bytes"]): (r["spans"], r["kept"]) for r in suffix_dedup.remove_repeats(docs, hot).collect()} for hot in (1 << 18, 4))
    assert whole == split and len(long) > 1_000_000
    want = removed(rows)
    assert all((n, sum(s["end"] - s["start"] for s in spans), len(spans), hashlib.sha256(kept).hexdigest()) == want[i] for (i, n), (spans, kept) in whole.items() if i is not None and (i != 7 or n > len(passage)))
    assert whole[None, len(passage)][1] == b"" and whole[7, len(passage)][1] == b""  # smaller documents have the passage


def test_index_family():
    rng = np.random.default_rng(0)
    family, text = suffix_dedup.IndexFamily(), rng.integers(97, 123, 40_000).astype(np.uint8).tobytes()
    pieces = lambda *x: suffix_dedup.Pieces(np.frombuffer(b"".join(x), np.uint8), np.array([len(p) for p in x]))
    for k in range(64):
        assert not len(family.add(pieces(text[600 * k : 600 * k + 80], text[600 * k : 600 * k + 80]), np.array([k, k]))[0])  # one document never removes its own
    assert len(family.levels) <= 8 and sum(len(level) for level, _ in family.levels) == 64 * 31
    assert all((level[1:] > level[:-1]).all() for level, _ in family.levels)
    piece, a, b = family.add(pieces(b"\0" * 9 + text[610:675] + b"\0"), np.array([99]))
    assert (piece.tolist(), a.tolist(), b.tolist()) == ([0], [9], [74])


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x = "</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use</div>{}<section id="comments"><p>nice</p></section><form><label>Name</label></form><footer>&copy; x</footer></body>"""


def test_html(spark):
    pages = [
        (0, "http://a.example/1", PAGE.format("<article><h1>T &eacute;</h1><p>a  b<br>c <i>d</i>e<p>2 &lt; 3<aside>x</aside></article>"), "T é a b c de 2 < 3"),
        (1, "http://a.example/2", PAGE.format("<article><h1>U</h1></article>"), "U"),
        (2, "http://b.example/1", PAGE.format("<div class='content with-sidebar'><p>one</p><!-- <p>no</p> --><p>two</p></div>"), "one two"),
        (3, None, None, ""),
        (4, "http://a.example/3", "", ""),
        (5, "http://c.example/x", "just <b>te</b>xt < 5 & more", "just text < 5 & more"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect()}
    assert got == {p[0]: (p[3], len(p[3])) for p in pages}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_slots_come_from_the_wrapper(spark):
    menu = "<div class='zq1'><p>Start<p>Shop</div>"  # no listed class or element
    body = "<body>{}{}<div class='zq2'><p>Call us</div></body>"
    rows = [(k, f"http://a.example/{k}", body.format(menu, f"<div><h2>Title {k}</h2>" + "".join(f"<p>story {k} {j}" for j in range(1 + k % 3)) + "</div>")) for k in range(6)]
    rows += [(200 + k, f"http://c.example/{k}", body.format("", f"<article><p>read {k}<p>Share this page</article>")) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert all(got[k] == " ".join([f"Title {k}"] + [f"story {k} {j}" for j in range(1 + k % 3)]) for k in range(6))
    assert all(got[200 + k] == f"read {k}" for k in range(4))


def test_html_copies_are_one_page(spark):
    page = "<body><div><p>copied story</div><div><p>call us</div></body>"
    rows = [(k, f"http://b.example/{k}", page) for k in range(9)]
    rows += [(100 + k, f"http://c.example/{k}", page if k < 9 else f"<body><div><p>story {k}</div><div><p>call us</div></body>") for k in range(13)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    # one distinct page does not tell template from content; five do
    assert all(got[k] == "copied story call us" for k in range(9))
    assert [got[100 + k] for k in range(13)] == ["copied story"] * 9 + [f"story {k}" for k in range(9, 13)]


def test_wrapper_alignment():
    a, b = (html_extract.signature(html_extract.blocks(f"<body>{x}</body>")) for x in ("<p>a</p><p>b</p>", "<h1>t</h1><p>a</p>"))
    wrapper = html_extract.align(a, b)
    kinds = [i[0] for i in wrapper]
    assert "?" in kinds and sum(i[0] == "+" for i in wrapper) == 1


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    path = str(tmp_path / "documents.parquet")
    docs.drop("size").write.parquet(path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {*range(len(TEXTS)), None} and 5 in {r["doc_id"] for r in rows} | {7}
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    own, stages = spark.read.parquet(path), corpus_pipeline.STAGES
    assert [n for n, _ in stages][0] == "quality rules" and all(f(spark, own, "").columns == own.columns for _, f in stages[:-1])
