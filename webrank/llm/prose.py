"""Telling prose from keyword lists, link lists and tags by perplexity over function words and word classes.

Frequent words stand for themselves, all other tokens for their class (lower case, capitalised, number, mixed, with letters
beyond ASCII, so that wrongly decoded words are no different from right ones). A trigram model of these, trained on
prose, gives each token a log-probability. Prose of one collection lacks the forms of lists that another holds, so the model is trained in two
steps: first on the given prose, by which pages are read as mainly prose if most of their words stand in lines that
read as sentences; then on the prose and the bodies of those pages. The flag is the perplexity of a page's whole body under
the second model, abnormally high or low against the pages it was trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm.linecodes import END, MIXED, NUMBER, SIGN, START, Lines, Vocabulary, plain, sequences, slices, small

#: A word is a function word of a language if it occurs in this share of the language's texts, and in this many at least.
FUNCTION_SHARE = 0.25
FUNCTION_TEXTS = 5
TABLE = 1 << 20
HELD_OUT = 8
MIN_TOKENS = 6
#: Shares of held-out prose tokens' lines left outside the band at either end.
TAILS = (0.004, 0.0005)
#: The ends of the band of lines are moved out by this much, for the few held-out lines of a small collection.
LINE_ROOM = 0.05
#: A line of a term or link and then a sentence: far below the band, but with this share of function words.
FAR, FUNCTION_RATE = 3.0, 0.25
#: Least share of words in such lines of the pages that the second step is trained on.
TRAINING_SHARE = 0.38
#: Share of the training pages that may lie beyond either end of the band of pages, and how far the ends are moved out.
PAGE_TAIL, PAGE_ROOM = 0.001, 0.15
RUN = re.compile("[^ \t\r\n]+")
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\w\s]")
BINS, SCALE = 1200, 50.0
#: Bytes of codes that are counted or scored at a time: the arrays made for it are many times as large.
CODE_BYTES = 1 << 19


def tokens(line: str) -> list[str]:
    """Words, numbers and single signs of a line; a run with a character beyond ASCII is one token."""
    if line.isascii():
        return TOKEN.findall(line)
    out: list[str] = []
    for run in RUN.findall(line):
        out += TOKEN.findall(run) if run.isascii() else [run]
    return out


def _slots(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of (a, b), (b, c) and (a, b, c)."""
    mask = TABLE - 1
    return (a * 40503 + b * 69621) & mask, (b * 40503 + c * 69621) & mask, (a * 22695477 + b * 1103515 + c * 134775813) & mask


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, c, place)`` of the trigrams inside the lines of a sequence, ``place`` that of ``c``."""
    codes = codes.astype(np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inside = np.flatnonzero((c != START) & (b != END) & (a != END))
    return a[inside], b[inside], c[inside], inside + 2


class Counts:
    """Counts of tokens, of pairs and of triples in hashed tables of ``TABLE`` entries, for one partition or for all."""

    def __init__(self, tables: np.ndarray | None = None):
        self.tables = np.zeros((3, TABLE), np.int64) if tables is None else tables

    def add(self, codes: np.ndarray) -> None:
        if len(codes) < 3:
            return
        a, b, c, _ = _grams(codes)
        lines = int((codes == END).sum())
        _, bc, abc = _slots(a, b, c)
        start = np.array([START], np.int64)
        for table, where in zip(self.tables, (c, bc, abc)):
            table += np.bincount(where, minlength=TABLE)
        self.tables[0, START] += lines
        self.tables[1, _slots(start, start, start)[0]] += lines

    def batch(self) -> pa.RecordBatch:
        flat = self.tables.reshape(-1)
        used = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["slot", "n"])

    @classmethod
    def collected(cls, df: DataFrame) -> Counts:
        """The sum of all batches: at most three tables of slots come to the driver, whatever the input."""
        rows = df.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        tables = np.zeros(3 * TABLE, np.int64)
        tables[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
        return cls(tables.reshape(3, TABLE))


@dataclass
class ProseModel:
    """Interpolated trigrams over class codes, the band of lines of prose and the band of pages."""

    words: list[str]
    tables: np.ndarray
    band: tuple[float, float] = (-1e9, 1e9)
    pages: tuple[float, float] = (-1e9, 1e9)

    def __post_init__(self) -> None:
        self.vocabulary = Vocabulary(self.words)
        n = len(self.words) + 8
        self.function, self.sign = np.zeros(n, bool), np.zeros(n, bool)
        self.function[8:] = [w[0].isalpha() for w in self.words]
        self.sign[8:] = [not w[0].isalnum() for w in self.words]
        self.sign[[NUMBER, MIXED, SIGN]] = True
        self.total = float(self.tables[0].sum()) + 1.0

    def logs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, log-probability)`` of every token and line end of a sequence."""
        if len(codes) < 3:
            return np.zeros(0, np.int64), np.zeros(0)
        a, b, c, place = _grams(codes)
        ab, bc, abc = _slots(a, b, c)
        one, two, three = self.tables
        p1 = (one[c] + 0.1) / self.total
        p2 = (two[bc] + 5.0 * p1) / (one[b] + 5.0)
        return place, np.log((three[abc] + 5.0 * p2) / (two[ab] + 5.0))

    def means(self, owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """Mean log-probability of the tokens of each of ``n`` owners, 0 for one without tokens."""
        place, logs = self.logs(codes)
        of = owner[place]
        return np.bincount(of, logs, minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    def prose(self, line: np.ndarray, codes: np.ndarray, page: np.ndarray, n_pages: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of each page's words that stand in lines of prose, 1 without words, and the number of its words.

        ``line`` owns each code and ``page`` each line. A line of ``MIN_TOKENS`` tokens is prose if its mean log-probability
        is inside the band, or not below ``FAR`` times its lower end with ``FUNCTION_RATE`` of function words.
        """
        n = len(page)
        mean = self.means(line, codes, n)
        real = codes != START
        real &= codes != END
        size = np.bincount(line[real], minlength=n)
        words = size - np.bincount(line[self.sign[codes]], minlength=n)
        helpers = np.bincount(line[self.function[codes]], minlength=n)
        low, high = self.band
        good = (mean >= low) & (mean <= high) | (mean >= FAR * low) & (mean < low) & (helpers >= FUNCTION_RATE * words)
        good &= size >= MIN_TOKENS
        total = np.bincount(page, words, minlength=n_pages)
        held = np.bincount(page[good], words[good], minlength=n_pages)
        return np.where(total > 0, held / np.maximum(total, 1), 1.0), total.astype(np.int64)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`prose` of texts of lines."""
        shares, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for at, end in slices(texts):
            lines = Lines([plain(x) for x in texts[at:end]])
            line, codes = sequences(*lines.tokens(self.vocabulary), np.ones(lines.n_lines, bool))
            share, size = self.prose(line, codes, lines.page, end - at)
            shares.append(share)
            sizes.append(size)
        return np.concatenate(shares), np.concatenate(sizes)

    def abnormal(self, means: np.ndarray) -> np.ndarray:
        """Whether a page of this mean log-probability lies outside the band of pages."""
        return (means < self.pages[0]) | (means > self.pages[1])


def language(lang: str | None) -> str:
    """Languages by the first part of their tag, in lower case: ``en-GB`` is ``en``."""
    return re.split("[-_]", (lang or "").strip().lower())[0]


def _encoded(batch: pa.RecordBatch, vocabulary: Vocabulary, held: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(line, code)`` of the lines that are held out of the training, one in ``HELD_OUT`` by their text, or of all others."""
    for part in small(iter([batch])):
        texts = part.column(0).to_pylist()
        for at, end in slices(texts):
            lines = Lines(texts[at:end])
            yield sequences(*lines.tokens(vocabulary), (lines.line_hashes() % np.uint64(HELD_OUT) == 0) == held)


def train(df: DataFrame, text: str, lang: str | None = None) -> ProseModel:
    """The model of all lines of ``text``: function words, counts and band each in a pass over all rows.

    Function words are those in at least ``FUNCTION_SHARE`` of the texts of a language (of all texts where no column is
    given) and in ``FUNCTION_TEXTS`` of them; texts hold few distinct words in a quarter of all texts, as each text lends
    weight only to words it has, so their number is bounded by four times the mean number of distinct words of a text and
    language. They, the used slots of tables of ``TABLE`` entries and a histogram of ``BINS`` bins are all that comes to
    the driver. An empty table gives a model without a band.
    """
    group = F.col(lang) if lang else F.lit("")
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), group.alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for x, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = language(tag)
                found.update((key, t) for t in {t for t in tokens(x) if t.isascii() and not t.isdigit()})
                found[key, ""] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    spread_of = texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    groups = spread_of.where("word = ''").select("lang", F.col("n").alias("all"))
    common = spread_of.where("word <> ''").join(groups, "lang").where((F.col("n") >= FUNCTION_SHARE * F.col("all")) & (F.col("n") >= FUNCTION_TEXTS))
    words = sorted(r.word for r in common.select("word").distinct().collect())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(words), Counts()
        for batch in batches:
            for _, codes in _encoded(batch, vocabulary, False):
                counts.add(codes)
        yield counts.batch()

    tables = Counts.collected(texts.mapInArrow(grams, "slot bigint, n bigint")).tables.astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hist = ProseModel(words, tables), np.zeros(BINS, np.int64)
        for batch in batches:
            for line, codes in _encoded(batch, model.vocabulary, True):
                if len(codes):
                    means = model.means(line, codes, int(line[-1]) + 1)
                    size = np.bincount(line, minlength=len(means)) - 3
                    wide = size >= MIN_TOKENS
                    bins = np.minimum(BINS - 1, (-means[wide] * SCALE).astype(np.int64))
                    hist += np.bincount(bins, size[wide], minlength=BINS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(hist)], names=["bin", "n"])

    low, high = histogram_ends(texts.mapInArrow(spread, "bin bigint, n bigint"), *TAILS)
    return ProseModel(words, tables, (low - LINE_ROOM, high + LINE_ROOM))


def histogram_ends(df: DataFrame, worst: float, best: float) -> tuple[float, float]:
    """The ends that leave these shares of all counts below and above, from ``(bin, n)`` of mean log-probabilities."""
    hist = df.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    total = hist["n"].sum() if len(hist) else 0
    if not total:
        return -1e9, 1e9
    share = hist.set_index("bin")["n"].reindex(range(BINS), fill_value=0).cumsum().to_numpy() / total
    return -(int(np.searchsorted(share, 1 - worst)) + 1) / SCALE, -int(np.searchsorted(share, best)) / SCALE


def second_step(model: ProseModel, bodies: DataFrame) -> ProseModel:
    """The model trained on its prose and on the ``bodies(codes, prose_share, n_tokens)`` that are mainly prose, with the band of pages.

    The band leaves ``PAGE_TAIL`` of these pages outside at either end and is then widened by ``PAGE_ROOM`` of its ends, so
    that no page it was trained on is near them. Without such pages the band is that of far lines.
    """
    chosen = bodies.where((F.col("prose_share") >= TRAINING_SHARE) & (F.col("n_tokens") > 0)).select("codes")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in few(batches):
            counts.add(joined(batch.column("codes"))[1])
        yield counts.batch()

    more = Counts.collected(chosen.mapInArrow(grams, "slot bigint, n bigint")).tables
    words, tables = model.words, np.minimum(model.tables.astype(np.int64) + more, 2**31 - 1).astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hist = ProseModel(words, tables), np.zeros(BINS, np.int64)
        for batch in few(batches):
            means = scorer.means(*joined(batch.column("codes")), batch.num_rows)
            hist += np.bincount(np.minimum(BINS - 1, (-means * SCALE).astype(np.int64)), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(hist)], names=["bin", "n"])

    low, high = histogram_ends(chosen.mapInArrow(spread, "bin bigint, n bigint"), PAGE_TAIL, PAGE_TAIL)
    if low == -1e9:
        return ProseModel(words, tables, model.band, (FAR * model.band[0], model.band[1]))
    return ProseModel(words, tables, model.band, (low * (1 + PAGE_ROOM), high * (1 - PAGE_ROOM)))


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of pages with ``codes`` in pieces of at most ``CODE_BYTES`` of them, one page at least."""
    for batch in small(batches):
        for at, end in slices([x or b"" for x in batch.column("codes").to_pylist()], CODE_BYTES):
            yield batch.slice(at, end - at)


def joined(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, code)`` of the sequences of all pages of a binary array."""
    parts = [np.frombuffer(x or b"", np.uint16) for x in bodies.to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return owner, np.concatenate(parts) if parts else np.zeros(0, np.uint16)
