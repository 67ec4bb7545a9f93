"""Lines, words and tokens of whole batches of texts as NumPy arrays: no loop over lines, words or characters.

A batch is one array of code points. Lines end at line feeds, words are runs without white space, runs of digits are one
digit. Names of a line (its shape, its words, its word pairs, its pattern of short and long words) become 64-bit keys, and
tokens become codes of function words and word classes. Every word of every line takes part, however long the line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from webrank.llm.hashing import BASE, INVERSE, mix, powers, prefix_hash

MARK = "\x01"
ANCHOR = re.compile(r"<a(?:\s[^>\n]*)?>", re.I)
ANY_TAG = re.compile(r"<[^>\n]*>")
STRIP = ".,;:!?()"
SIGNS = "|·>©:?"
SIGN_KINDS = np.zeros(256, np.int64)
for _k, _c in enumerate(SIGNS):
    SIGN_KINDS[ord(_c)] = _k + 1
SLICE_CHARS = 1 << 16
SHORT = 14
#: The last bits of a name's key tell its kind.
KINDS = 16
NODE = 15
SPACE, DIGIT, ALNUM, UPPER, EDGE, BEYOND, WORD, ALPHA = (1 << i for i in range(8))
LOWER, CAPITAL, NUMBER, MIXED, FOREIGN, SIGN, START, END = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The flags of every code point, as Python's string methods tell them."""
    points = np.arange(0x110000, dtype=np.uint32)
    chars = points.view("<U1")
    out = np.char.isspace(chars) * np.uint8(SPACE)
    out |= np.char.isdecimal(chars) * np.uint8(DIGIT)
    out |= np.char.isalnum(chars) * np.uint8(ALNUM)
    out |= np.char.isupper(chars) * np.uint8(UPPER)
    out |= (points > 0x7F) * np.uint8(BEYOND)
    out |= ((points < 0x80) & (np.char.isalnum(chars) | (points == ord("_")))) * np.uint8(WORD)
    out |= ((points < 0x80) & np.char.isalpha(chars)) * np.uint8(ALPHA)
    out[[ord(c) for c in STRIP]] |= np.uint8(EDGE)
    return out


def plain(text: str) -> str:
    """The text without tags, a mark at each anchor and entities resolved; the number of lines stays the same."""
    if "<" in text:
        text = ANY_TAG.sub("", ANCHOR.sub(f" {MARK} ", text))
    if "&" in text:
        text = "\n".join(html.unescape(x).replace("\n", " ") if "&" in x else x for x in text.split("\n"))
    return text


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> list[tuple[int, int]]:
    """``(start, end)`` of runs of texts with at most ``limit`` characters, one text at least."""
    out, at, size = [], 0, 0
    for i, x in enumerate(texts):
        if i > at and size + len(x) > limit:
            out.append((at, i))
            at, size = i, 0
        size += len(x) + 1
    return [*out, (at, len(texts))] if texts else []


class Lines:
    """The lines of a few texts: ``page`` of each line, and its words by the arrays below."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        flags = _classes()[codes]
        digit = (flags & DIGIT) != 0
        keep = np.ones(len(codes), bool)
        keep[1:] = ~(digit[1:] & digit[:-1])
        codes, flags = codes[keep].copy(), flags[keep].copy()
        digit = digit[keep]
        codes[digit], flags[digit] = ord("0"), DIGIT | ALNUM | WORD
        self.codes, self.flags = codes, flags
        counts = np.array([x.count("\n") + 1 for x in texts], np.int64)
        self.page = np.repeat(np.arange(len(texts)), counts)
        self.first_line = np.cumsum(counts) - counts
        self.n_lines = int(counts.sum())
        n = len(codes)
        solid = (flags & SPACE) == 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        breaks = np.zeros(n + 1, np.int64)
        np.cumsum(codes == 10, out=breaks[1:])
        self.breaks = breaks
        self.line = breaks[self.starts]
        self.H = prefix_hash(codes)
        self.inverse = powers(INVERSE, n + 1)
        self.n_words = np.bincount(self.line, minlength=self.n_lines)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self.marks = (codes[self.starts] == ord(MARK)) & (self.ends - self.starts == 1)
        #: lines with text beyond marks
        self.filled = np.bincount(self.line[~self.marks], minlength=self.n_lines) > 0

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the runs from ``s`` to ``e``, whatever their place."""
        return mix((self.H[e] - self.H[s]) * self.inverse[s])

    def line_hashes(self) -> np.ndarray:
        """A hash of the text of each line."""
        ends = np.append(np.flatnonzero(self.codes == 10), len(self.codes))
        return self.hashes(np.concatenate([[0], ends[:-1] + 1]), ends)

    def names(self, hosts: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(line, key)`` of every name of every line, a name as often as it occurs; a key modulo ``KINDS`` is the name's kind.

        With the ``hosts`` of the pages each line also has the name of its content node: its host with its words.
        """
        s, e, line, codes, flags = self.starts, self.ends, self.line, self.codes, self.flags
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        lines, keys = [], []

        def add(kind: int, where: np.ndarray, values: np.ndarray) -> None:
            lines.append(where)
            keys.append(mix(values.astype(np.uint64) * BASE) & ~np.uint64(KINDS - 1) | np.uint64(kind))

        full = np.flatnonzero(self.n_words)
        n, first = self.n_words[full], self.first_word[full]
        last = first + n - 1
        word = self.hashes(s, e)
        if hosts is not None:
            sites = np.array([xxhash.xxh3_64_intdigest((h or "").encode("utf-8", "replace")) for h in hosts], np.uint64)
            steps = powers(BASE, int(n.max()))[np.arange(len(s)) - self.first_word[line]]
            add(NODE, full, np.add.reduceat(word * steps, first) * BASE + sites[self.page[full]])
        add(1, full, np.where(n < 12, n, 12 + np.minimum(n // 10, 8)))
        add(2, full, codes[e[last] - 1])
        add(3, full, np.minimum(np.bincount(line[self.marks], minlength=self.n_lines)[full], 3))
        kinds = SIGN_KINDS[np.minimum(codes, len(SIGN_KINDS) - 1)]
        signs = np.flatnonzero(kinds)
        held = np.unique(self.breaks[signs] * 16 + kinds[signs])
        add(4, held // 16, held % 16)
        add(5, full, word[first])
        add(6, full, word[last])
        place = np.arange(len(s)) - self.first_word[line]
        upper = (flags[s] & UPPER) != 0
        capitals = np.bincount(line[(place < 6) & upper], minlength=self.n_lines)[full]
        add(7, full, capitals * 8 + np.minimum(n, 6))
        # words without the signs around them
        at = np.arange(len(codes))
        edge = (flags & EDGE) != 0
        nxt = np.minimum.accumulate(np.where(edge, len(codes), at)[::-1])[::-1]
        prv = np.maximum.accumulate(np.where(edge, -1, at))
        left = np.minimum(nxt[s], e)
        # words tell something else in paragraphs than in short lines
        long = (self.n_words > SHORT)[line]
        bare = self.hashes(left, np.maximum(prv[e - 1] + 1, left))
        pair = np.flatnonzero(line[1:] == line[:-1])
        two = word[pair] * BASE + word[pair + 1]
        for kind, which in ((8, ~long), (13, long)):
            add(kind, line[which], bare[which])
            add(kind + 1, line[pair][which[pair]], two[which[pair]])
        # the pattern of a line: short words and signs stand, longer words are told by their first letter's case
        tail = np.where(edge[e - 1], codes[e - 1], 0)
        ends = np.where(e - s < 5, word, mix(upper.astype(np.uint64) * np.uint64(1 << 32) + tail.astype(np.uint64)))
        head, foot, whole = (np.zeros(len(full), np.uint64) for _ in range(3))
        for j in range(10):
            more = n > j
            step = ends[np.minimum(first + j, last)]
            whole = np.where(more, whole * BASE + step, whole)
            if j < 5:
                head = np.where(more, head * BASE + step, head)
                place_ = last - 4 + j
                foot = np.where(place_ >= first, foot * BASE + ends[np.maximum(place_, 0)], foot)
        add(10, full, head)
        add(11, full, foot)
        short = n <= 10
        add(12, full[short], whole[short])
        return np.concatenate(lines), np.concatenate(keys)

    def tokens(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """``(line, code)`` of every token: words, numbers and single signs; a run with a character beyond ASCII is one token."""
        s, e, flags = self.starts, self.ends, self.flags
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = np.zeros((4, len(flags) + 1), np.int32)
        for row, bit in zip(sums, (BEYOND, ALNUM, DIGIT, ALPHA)):
            np.cumsum((flags & bit) != 0, out=row[1:])
        high = sums[0][e] > sums[0][s]
        begins = np.zeros(len(flags) + 1, bool)
        begins[s] = True
        inner = (flags & WORD) != 0
        split = self.solid & ~inner
        split[1:] |= self.solid[1:] & inner[1:] & ~inner[:-1]
        owner = np.cumsum(begins[:-1]) - 1
        split &= ~high[np.maximum(owner, 0)]
        ts = np.flatnonzero(split | begins[:-1])
        word = owner[ts]
        te = np.minimum(np.append(ts[1:], len(flags)), e[word])
        code = vocabulary.codes(self.hashes(ts, te))
        size = te - ts
        alpha = sums[3][te] - sums[3][ts] == size
        number = sums[2][te] - sums[2][ts] == size
        shape = np.where(inner[ts], MIXED, SIGN)
        shape = np.where(alpha, np.where((flags[ts] & UPPER) != 0, CAPITAL, LOWER), shape)
        shape = np.where(number, NUMBER, shape)
        odd = (sums[1][te] > sums[1][ts]) | (self.codes[ts] == 0xFFFD) | (self.codes[te - 1] == 0xFFFD)
        shape = np.where(high[word], np.where(odd, FOREIGN, SIGN), shape)
        return self.line[word], np.where((code >= 0) & ~high[word], code, shape)


class Vocabulary:
    """Codes of words by their hash."""

    def __init__(self, words: list[str]):
        lines = Lines([" ".join(words)]) if words else None
        hashes = lines.hashes(lines.starts, lines.ends) if lines else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], order + 8

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 if it is of no word here."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], -1)


def sequences(line: np.ndarray, code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, code)`` of the ``wanted`` lines that have tokens, each between two starts and an end."""
    keep = wanted[line]
    line, code = line[keep], code[keep]
    counts = np.bincount(line, minlength=len(wanted))
    full = np.flatnonzero(counts)
    sizes = counts[full] + 3
    offsets = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), START, np.uint16)
    base = np.zeros(len(wanted), np.int64)
    base[full] = offsets + 2 - (np.cumsum(counts) - counts)[full]
    out[np.arange(len(code)) + base[line]] = code
    out[offsets + sizes - 1] = END
    return np.repeat(full, sizes), out


class Table:
    """Rows by 64-bit key, found for whole arrays of keys by open addressing."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        keys = keys.astype(np.uint64)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.rows = np.zeros(size, np.uint64), np.zeros((size, rows.shape[1]), np.float32)
        used = np.zeros(size, bool)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            _, one = np.unique(at, return_index=True)
            one = one[~used[at[one]]]
            used[at[one]] = True
            self.keys[at[one]], self.rows[at[one]] = keys[left[one]], rows[left[one]]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & int(self.mask)
        self.used = used

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, that of an empty row for keys that are not there."""
        at = (keys & self.mask).astype(np.int64)
        going = np.flatnonzero(self.used[at] & (self.keys[at] != keys))
        while len(going):
            at[going] = (at[going] + 1) & int(self.mask)
            now = at[going]
            going = going[self.used[now] & (self.keys[now] != keys[going])]
        return at

    def sums(self, line: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """The sum of the rows of each line's keys."""
        found = self.find(keys)
        hit = self.used[found]
        line, found = line[hit], found[hit]
        return np.stack([np.bincount(line, self.rows[found, k], minlength=n) for k in range(self.rows.shape[1])], axis=1)
