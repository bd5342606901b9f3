"""Main text of web pages by union-free regular expressions inferred per host.

A page is a stream of block tags and text slots.  Runs that repeat are folded into repeated
groups; the folded streams of a host are aligned one after another, and what one lacks
becomes an optional group, until one expression without alternatives, the wrapper, accepts
all of them.  Every slot of a wrapper has a role from the elements around it: chrome (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), article, or plain.
A page is then matched with its host's wrapper, which says in which slot each of its texts
stands.  A text that stands in one slot on most of the host's distinct pages, three at least,
is template, whatever its role; what varies is content.  Of the content, article slots are taken
where the page has any, else plain ones.  Pages with the same texts count as one page, so copies
do not make a page's text template; a host with fewer than three distinct pages has no template.

Equal streams are counted once, so a host with a third of all pages is a few streams; they
are aligned in a tree: first in 16 shares, then the shares' wrappers.

Defined results: null html gives empty text; rows are read one by one, so repeated rows give
repeated results; a null or unreadable url counts as the host ""; an unclosed or stray tag only
ends a block; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, lean

#: Elements whose content is never text, and elements that stand inside a block (fixed values of the language).
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "title", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What surrounds chrome: elements, and words in class, id and role.
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "sidebar", "side", "aside", "widget", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "cookie", "cookies", "consent", "notice", "gdpr",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related",
    "recommended", "pagination", "pager", "toolbar", "skip", "complementary", "contentinfo",
}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SHARES = 16
#: Distinct pages of a host that a text must be on to be template.
LEAST_PAGES = 3


def marks(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, sorted; camel case and signs part words. Names such as "has-sidebar" say what is beside an element, not what it is."""
    found = set()
    for value in NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
            if words and words[0] not in ("with", "has", "no", "without"):
                found.update(words)
    return tuple(sorted(found))


def blocks(page: str):
    """The page in order: ("<", element, words of its names), (">", element) and ("#", text) with inline tags taken out."""
    at, text, out = 0, [], []

    def flush():
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            if s:
                out.append(("#", s))
            text.clear()

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if name in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if end is None:
                    at = at if name in ("head", "title") else n
                else:
                    at = end.end()
        elif name == "br":
            text.append(" ")
        elif name in INLINE:
            pass  # part of its block, whatever its name
        else:
            flush()
            if name in VOID:
                continue
            out.append((">", name, ()) if closing else ("<", name, marks(m[3] or m[6] or "")))
    flush()
    return out


def is_chrome(name: str, names, in_article: bool) -> bool:
    if name in CHROME or (name == "header" and not in_article):
        return True
    # an article's own header holds its title
    words = CHROME_WORDS - {"header", "masthead"} if in_article else CHROME_WORDS
    return name not in ("html", "body", "article", "main") and bool(words & set(names))


def roles(stream):
    """(role, path) of each text of a stream: "chrome", "article" or "plain", by the elements that are open there."""
    open_now: list[tuple[str, str]] = []
    out = []
    for t in stream:
        if t[0] == "<":
            above = open_now[-1][1] if open_now else "plain"
            if t[1] in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_now and open_now[-1][0] == t[1]:
                open_now.pop()  # these end where the next one begins
                above = open_now[-1][1] if open_now else "plain"
            if above == "chrome" or is_chrome(t[1], t[2], above == "article"):
                role = "chrome"
            elif t[1] in ("article", "main"):
                role = "article"
            else:
                role = above
            open_now.append((t[1], role))
        elif t[0] == ">":
            for k in range(len(open_now) - 1, -1, -1):
                if open_now[k][0] == t[1]:
                    del open_now[k:]
                    break
        else:
            out.append((open_now[-1][1] if open_now else "plain", "/".join(n for n, _ in open_now[-4:])))
    return out


# ---- wrappers: lists of items; an item is ["t", tag], ["#", role], ["+", items] or ["?", items]


def signature(stream) -> list:
    """The folded stream of a page, its texts replaced by slots with their roles."""
    return placed(stream)[0]


def placed(stream) -> tuple[list, list[int]]:
    """The signature, and how many of the page's texts stand in each of its items."""
    slot = iter(roles(stream))
    flat = []
    for t in stream:
        if t[0] == "#":
            flat.append(["#", next(slot)[0]])
        else:
            flat.append(["t", t[0] + t[1] + ("." + ".".join(t[2]) if t[2] else "")])
    # an element with only a text in it, or nothing, is a group from the start, so that one and many of it fold alike
    out, held, k = [], [], 0
    while k < len(flat):
        end = k + 1
        if flat[k][0] == "t" and flat[k][1][0] == "<":
            while end < len(flat) and flat[end][0] == "#":
                end += 1
            name = flat[k][1][1:].split(".")[0]
            closes = end < len(flat) and flat[end] == ["t", ">" + name]
            if closes or (name in ("p", "li", "dt", "dd", "td", "th") and end > k + 1):
                role = flat[k + 1][1] if end > k + 1 else ""
                out.append(["+", [["t", flat[k][1]], ["#", role]]])
                held.append(end - k - 1)
                k = end + closes
                continue
        if flat[k] not in (["t", ">p"], ["t", ">li"]):
            out.append(flat[k])
            held.append(int(flat[k][0] == "#"))
        k += 1
    return fold(out, held)


def fold(items: list, held: list[int], widest: int = 8) -> tuple[list, list[int]]:
    """Runs of equal item lists become one repeated group, shortest runs first, until nothing repeats; ``held`` are the texts in each item."""
    for width in range(1, widest + 1):
        out, sums, k = [], [], 0
        while k < len(items):
            body = items[k : k + width]
            n = 1
            while len(body) == width and items[k + n * width : k + (n + 1) * width] == body:
                n += 1
            if n > 1:
                out.append(body[0] if width == 1 and body[0][0] == "+" else ["+", body])
                sums.append(sum(held[k : k + n * width]))
                k += n * width
            else:
                out.append(items[k])
                sums.append(held[k])
                k += 1
        items, held = out, sums
    return items, held


def keys(items: list) -> list[str]:
    """Items for alignment: an optional group counts as what it holds."""
    return [json.dumps(i[1] if i[0] == "?" and len(i[1]) > 1 else i[1][0] if i[0] == "?" else i) for i in items]


def align(a: list, b: list) -> list:
    """The wrapper that accepts both: equal items stay, what only one side has becomes optional."""
    ka, kb = keys(a), keys(b)
    out = []
    optional = lambda items: [i if i[0] == "?" else ["?", [i]] for i in items]
    for op, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            out += [x if x[0] == "?" else y for x, y in zip(a[i:j], b[k:m])]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return out


def infer(streams: list[str]) -> str:
    """One wrapper for folded streams or wrappers given as JSON, aligned in their order."""
    out: list | None = None
    for s in streams:
        out = json.loads(s) if out is None else align(out, json.loads(s))
    return json.dumps(out or [])


@lru_cache(maxsize=512)
def wrapper_keys(wrapper: str) -> list[str]:
    return keys(json.loads(wrapper))


def match(items: list[str], wrapper: str) -> list[int]:
    """The place in the wrapper of each item of a signature, -1 where it has none; a signature is a subsequence of its host's wrapper."""
    where, at, out = wrapper_keys(wrapper), 0, []
    for item in items:
        k = at
        while k < len(where) and where[k] != item:
            k += 1
        out.append(k if k < len(where) else -1)
        at = k + 1 if k < len(where) else at
    return out


def in_slot(slot: int, text: int) -> int:
    """Identifier of a text, itself given by its hash, in a slot."""
    return int.from_bytes(blake2b(b"%d|%d" % (slot, text), digest_size=8).digest(), "little", signed=True)


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(page: str, wrapper: str, template: frozenset[int] = frozenset()) -> str:
    """The texts of a page's article slots, else of its plain ones, without those that are template in their slots of the wrapper."""
    stream = blocks(page)
    texts = [t[1] for t in stream if t[0] == "#"]
    of = [r for r, _ in roles(stream)]
    own = [True] * len(texts)
    if template:
        items, held = placed(stream)
        slots = [slot for slot, n in zip(match(keys(items), wrapper), held) for _ in range(n)]
        own = [slot < 0 or in_slot(slot, hashed(t)) not in template for slot, t in zip(slots, texts)]
    want = "article" if any(r == "article" and o for r, o in zip(of, own)) else "plain"
    return " ".join(t for t, r, o in zip(texts, of, own) if r == want and o)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper, template): the wrapper of each host, and the texts that stand in one slot of it on most of its distinct pages."""
    def streams(batches):
        for batch in batches:
            host, sig, held, texts = [], [], [], []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = blocks(page or "")
                items, counts = placed(stream)
                host.append(host_of(url))
                sig.append(json.dumps(items))
                held.append(counts)
                texts.append([hashed(t[1]) for t in stream if t[0] == "#"])
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(sig, pa.string()), pa.array(held, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))], names=["host", "signature", "held", "texts"])

    def slots(batches):
        for batch in batches:
            hosts, found = [], []
            for host, sig, held, texts, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                at = [slot for slot, n in zip(match(keys(json.loads(sig)), wrapper), held) for _ in range(n)]
                ids = sorted({in_slot(slot, t) for slot, t in zip(at, texts) if slot >= 0})
                hosts += [host] * len(ids)
                found += ids
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["host", "text"])

    rows = pages.select("url", "html").mapInArrow(lean(streams), "host string, signature string, held array<int>, texts array<long>")
    rows = scratch.write(rows, "streams")
    distinct = rows.groupBy("host", "signature").agg(F.count("*").alias("n"))
    one = lambda pdf: pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [infer(sorted(pdf["wrapper"]))]})
    shares = distinct.select("host", F.pmod(F.xxhash64("signature"), F.lit(SHARES)).alias("share"), F.col("signature").alias("wrapper"))
    partial = shares.groupBy("host", "share").applyInPandas(one, "host string, wrapper string")
    whole = scratch.write(partial.groupBy("host").applyInPandas(one, "host string, wrapper string"), "whole")
    # one page of each set of texts
    content = rows.withColumn("content", F.xxhash64(F.array_sort(F.array_distinct("texts"))))
    single = content.groupBy("host", "content").agg(F.min(F.struct("signature", "held", "texts")).alias("p")).select("host", "p.*")
    single = scratch.write(single, "single")
    total = single.groupBy("host").agg(F.count("*").alias("pages"))
    often = single.join(whole, "host").select("host", "signature", "held", "texts", "wrapper").mapInArrow(lean(slots), "host string, text long")
    often = often.groupBy("host", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    often = often.join(total, "host").filter("2 * n > pages").groupBy("host").agg(F.collect_list("text").alias("template"))
    return scratch.write(whole.join(often, "host", "left"), "wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "html")
    pages = pages.select("page_id", "url", "html")
    found = wrappers(pages, scratch)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            page_id, url, page, host, wrapper, template = batch.columns
            known: dict = {}
            texts = []
            for p, h, w, t in zip(page.to_pylist(), host.to_pylist(), wrapper.to_pylist(), template.to_pylist()):
                if h not in known:  # hosts can have one wrapper and different templates
                    known[h] = frozenset(t or ())
                texts.append(extract(p or "", w or "[]", known[h]))
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # the wrappers' table is written, so its size is known and Spark broadcasts it only under its own threshold
    rows = pages.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "host", "wrapper", "template")
    return rows.mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
