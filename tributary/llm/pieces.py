"""Encoding of texts by a `tokenizers` model, word by word, with each distinct word of a part of a batch encoded once.

A cut before a blank that follows a character other than white space never
changes the ids: no match of the splitting patterns used here has white space
after its first character unless it is all white space, and none looks back.
So a text is cut there, and the distinct words of a few megabytes are encoded
together in long strings, which are cut again by what their tokens say.  Words of
letters are remembered from one part to the next in arrays of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a string that is encoded at once.
TOGETHER = 4096
#: Bytes of words and ids that a worker remembers.
REMEMBERED = 1 << 25
#: Bytes of text whose distinct words are encoded together.
ENCODED = 1 << 22
#: White space other than the blank and the line feed (fixed values of the Unicode property), and blanks after white space.
UNSAFE = r"  |\n |^ |[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Signs after a letter are a match of their own. Words of letters and signs; words whose letters the lower-casing model leaves as they are.
SIGNS = r"[.,!?;:%&*$#]*"
LETTERS = rf"^(?P<stem>\p{{L}}+)(?P<tail>{SIGNS})$"
PLAIN = rf"^(?P<stem>[a-zß-öø-ÿ]+)(?P<tail>{SIGNS})$"


def flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slices of a pool, one after another."""
    return pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def paired(pool: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pool of words that are two segments each, where each word begins and its length; the number after the last segment's is an empty one."""
    at, n = np.append(np.cumsum(n) - n, 0), np.append(n, 0)
    each = n[pairs]
    pool = gathered(pool, at[pairs].ravel(), each.ravel())
    n = each.sum(axis=1)
    return pool, np.cumsum(n) - n, n


class Remembered:
    """Words and their ids; once they take ``REMEMBERED`` bytes only those of the last call stay."""

    def __init__(self, encode):
        self.encode = encode
        self.words, self.pool, self.n = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words one after another, and how many each has."""
        number = pc.index_in(words, value_set=self.words)
        new = flags(number.is_null())
        number = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = words.filter(pa.array(new))
        pool, n = self.encode(fresh)
        number[new] = len(self.words) + np.arange(len(fresh))
        pool, n = np.concatenate([self.pool, pool]), np.concatenate([self.n, n])
        out = gathered(pool, (np.cumsum(n) - n)[number], n[number]), n[number]
        if self.words.nbytes + fresh.nbytes + pool.nbytes + n.nbytes > REMEMBERED:
            self.words, (self.pool, self.n) = words, out
        else:
            self.words, self.pool, self.n = pa.concat_arrays([self.words, fresh]), pool, n
        return out


class Encoder:
    """Encodes texts by their words; what a word is and how words are encoded together is left to subclasses."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that are encoded one by one, and how many each has."""
        found = [np.zeros(0, "<u4")]
        for lo in range(0, len(parts), TOGETHER):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts[lo : lo + TOGETHER], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found[1:]], np.int64)

    def words(self, texts: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each word of ``lists`` where its ids begin and how many they are."""
        raise NotImplementedError

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        pool, at, n = self.words(texts, lists)
        upto = np.concatenate([[0], np.cumsum(n)])
        return gathered(pool, at, n), upto[lists.offsets.to_numpy()[1:]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the end of each text's; null counts as empty."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return self.split(pc.fill_null(texts.cast(pa.large_string()), ""))


class ByteEncoder(Encoder):
    """For models whose tokens are bytes of the text: words encoded together are told apart by their lengths."""

    def __init__(self, tokenizer, sizes: np.ndarray):
        super().__init__(tokenizer)
        self.sizes = sizes
        self.stems = Remembered(self.together)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        odd = np.flatnonzero(flags(unsafe)).tolist()
        if not odd:
            return self.split(texts)
        ids, ends = self.split(pc.if_else(unsafe, "", texts))
        each = np.split(ids, ends[:-1])
        for i in odd:
            each[i] = self.cut(texts[i].as_py())
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def cut(self, text: str) -> np.ndarray:
        """Ids of a text with other white space than single blanks and line feeds."""
        parts = text.split(" ")
        out, now = [], parts[0]
        for p in parts[1:]:
            if now and not now[-1].isspace():
                out.append(now)
                now = " " + p
            else:
                now += " " + p
        parts = list(dict.fromkeys([*out, now]))
        pool, n = self.each(parts)
        number = {p: k for k, p in enumerate(parts)}
        which = np.array([number[p] for p in [*out, now]])
        return gathered(pool, (np.cumsum(n) - n)[which], n[which])

    def together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a blank before each, and how many each has."""
        pools, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        for lo in range(0, len(words), TOGETHER):
            pools.append(self.ids(" " + " ".join(words.slice(lo, TOGETHER).to_pylist())))
            ends = np.searchsorted(np.cumsum(self.sizes[pools[-1]]), np.cumsum(lengths[lo : lo + TOGETHER])) + 1
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(pools), np.concatenate(sizes)

    def words(self, texts, lists):
        firsts = lists.offsets.to_numpy()[:-1]
        codes = lists.values.dictionary_encode()
        distinct, index = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = pc.extract_regex(distinct, LETTERS)
        # a line feed at the end may meet the blank of the next word
        alone = flags(pc.or_(pc.equal(distinct, ""), pc.ends_with(distinct, pattern="\n")))
        plain = flags(cut.is_valid())
        groups = [np.flatnonzero(~plain & ~alone), np.flatnonzero(alone)]
        plain = np.flatnonzero(plain)
        cut = cut.take(pa.array(plain))
        stems, tails = (pc.struct_field(cut, k).dictionary_encode() for k in range(2))
        # segments: stems, other words, words that are encoded alone, the first word of each text, tails
        made = [self.stems.look_up(stems.dictionary), self.together(distinct.take(pa.array(groups[0])))]
        made += [self.each(x) for x in ([" " + p for p in distinct.take(pa.array(groups[1])).to_pylist()], lists.values.take(pa.array(firsts)).to_pylist(), tails.dictionary.to_pylist())]
        pool, n = (np.concatenate([m[k] for m in made]) for k in range(2))
        begin = np.cumsum([0, *(len(m[1]) for m in made)])
        pairs = np.full((len(distinct) + len(firsts), 2), len(n))
        pairs[plain, 0] = stems.indices.to_numpy(zero_copy_only=False)
        pairs[plain, 1] = begin[4] + tails.indices.to_numpy(zero_copy_only=False)
        pairs[np.concatenate(groups), 0] = np.arange(begin[1], begin[3])
        pairs[len(distinct) :, 0] = np.arange(begin[3], begin[4])
        index[firsts] = len(distinct) + np.arange(len(firsts))
        pool, at, n = paired(pool, n, pairs)
        return pool, at[index], n[index]


class WordEncoder(Encoder):
    """For models that drop white space and mark the last token of a match: plain words encoded together are told apart by the marks."""

    def __init__(self, tokenizer, plain, last: np.ndarray):
        """plain: the same model for words of a-z with blanks between them; last: by id, whether a token ends a match."""
        super().__init__(tokenizer)
        self.plain, self.last = plain, last
        self.known = Remembered(self.stems)

    def split(self, texts):
        return super().split(pa.array([folded(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary()).cast(pa.large_string()))

    def together(self, words: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray]:
        pools, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), TOGETHER):
            some = words.slice(lo, TOGETHER).to_pylist()
            ids = self.ids(" ".join(some), tokenizer)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # words that are more than one match after all
                ids, n = self.each(some)
            else:
                n = np.diff(ends, prepend=0)
            pools.append(ids)
            sizes.append(n)
        return np.concatenate(pools), np.concatenate(sizes)

    def stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain letters, those of a-z by the simpler tokenizer, and how many each has."""
        simple = flags(pc.string_is_ascii(words)) if len(words) else np.zeros(0, bool)
        groups = [np.flatnonzero(simple), np.flatnonzero(~simple)]
        made = [self.together(words.take(pa.array(g)), t) for g, t in zip(groups, (self.plain, self.tokenizer))]
        pool, n = (np.concatenate([m[k] for m in made]) for k in range(2))
        order = np.argsort(np.concatenate(groups))
        return gathered(pool, (np.cumsum(n) - n)[order], n[order]), n[order]

    def words(self, texts, lists):
        codes = lists.values.dictionary_encode()
        distinct, index = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = pc.extract_regex(distinct, PLAIN)
        plain, rest = np.flatnonzero(flags(cut.is_valid())), np.flatnonzero(flags(cut.is_null()))
        cut = cut.take(pa.array(plain))
        stems, tails = (pc.struct_field(cut, k).dictionary_encode() for k in range(2))
        # segments: stems, tails, other words
        made = [self.known.look_up(stems.dictionary), self.each(tails.dictionary.to_pylist()), self.each(distinct.take(pa.array(rest)).to_pylist())]
        pool, n = (np.concatenate([m[k] for m in made]) for k in range(2))
        # a word is a stem and a tail, or one other segment and an empty one at the end
        pairs = np.full((len(distinct), 2), len(n))
        pairs[plain, 0] = stems.indices.to_numpy(zero_copy_only=False)
        pairs[plain, 1] = len(stems.dictionary) + tails.indices.to_numpy(zero_copy_only=False)
        pairs[rest, 0] = len(stems.dictionary) + len(tails.dictionary) + np.arange(len(rest))
        pool, at, n = paired(pool, n, pairs)
        return pool, at[index], n[index]


def folded(raw: bytes) -> bytes:
    """A-Z in lower case, as a model that lower-cases does itself, unless an accent of its own may follow a letter; line feeds as blanks."""
    if b"\xcc" not in raw and b"\xcd" not in raw:
        raw = raw.lower()
    return raw.replace(b"\n", b" ")


def slices(texts: pa.Array, size: int = 1 << 21):
    """Parts of an array of about ``size`` bytes and where they begin, so that a batch of long texts is never held encoded at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield lo, texts.slice(lo, hi - lo)
