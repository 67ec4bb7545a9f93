"""Finding and restoring text that was decoded with the wrong character encoding.

A character trigram model is trained on clean records. Every word with a character beyond ASCII is tried under all chains
of encoding with one character set and decoding with another; chains that end in UTF-8 may act on a part of the word and
up to three times in a row. The likeliest reading is accepted if its log-likelihood beats the stored one by the margin of
its kind of chain, which is taken from clean records held out of the training. Once a single-byte chain is accepted for a word
of a record, all other words of the record are tried under it, however short they are. Replacement characters and control codes that
only a wrong decoding leaves behind mark a word that can't be restored in full.

Counts cover all clean records; they are kept in a table of ``TABLE`` slots, so the model has a fixed size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = 1 << 18
HELD_OUT = 8
CACHE = 200_000
MIN_SINGLE_BYTE = 3
QUANTILE = 0.999
OUTLIER = 6.0
#: How much a word read under a single-byte chain speaks for reading the other words of its line likewise.
LINE_ODDS = 2.0
#: Character sets whose bytes UTF-8 text is wrongly read as, and single-byte sets taken for one another.
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "koi8_r", "cp866", "iso8859_15")
SINGLE_BYTE = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")
#: A word that one of these explains is no clean training material, whatever the model says of it.
PLAIN = ("cp1252", "mac_roman", "cp437", "cp1251")
LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
#: Latin, Greek and Cyrillic letters, common marks, and the characters of Chinese, Japanese and Korean.
COMMON = re.compile("[\u00a1-\u017f\u0370-\u03ff\u0400-\u045f\u2010-\u22ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
#: Characters beyond these and below the pictographs come of bytes that make UTF-8 by chance, unless several of them stand together.
RARE = re.compile("[^\x00-\u017f\u0370-\u03ff\u0400-\u045f\u2010-\u22ff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af\ufe0f\U0001f000-\U0001ffff]")
RARE_TOGETHER = 3
SPLIT = re.compile("[ \t\r\n]+")
#: Whole tags, the end of one before a word and the beginning of one after it.
TAGS = re.compile(r"^[^<>]*>|<[^<>]*(?:>|$)")


def _table(name: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out.setdefault(bytes([b]).decode(name), b)
        except UnicodeDecodeError:
            continue
    if name == "cp1252":  # undefined and control bytes pass through as they do in browsers
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


TABLES = {n: _table(n) for n in dict.fromkeys((*UTF8_READ_AS, *SINGLE_BYTE))}


def _sequence(table: dict[str, int]) -> re.Pattern:
    def of(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"

    tail = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}})+")


SEQUENCES = {n: _sequence(TABLES[n]) for n in UTF8_READ_AS}
_TO_BYTES = {n: {ord(c): b for c, b in TABLES[n].items()} for n in TABLES}
_CROSS = {}
for _a in ("cp1252", *SINGLE_BYTE):
    for _b in SINGLE_BYTE:
        if _a != _b:
            _back = {b: c for c, b in TABLES[_b].items()}
            _CROSS[f"{_a}>{_b}"] = {ord(c): _back[b] for c, b in TABLES[_a].items() if b in _back}


def _decoded(run: str, name: str) -> str:
    try:
        return bytes(TABLES[name][c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return run


def from_utf8(word: str, name: str) -> str:
    """``word`` with every run of characters whose bytes under ``name`` are UTF-8 read as UTF-8."""
    return SEQUENCES[name].sub(lambda m: _decoded(m.group(), name), word)


def readings(word: str) -> dict[str, str]:
    """Other readings of ``word`` with the kind of chain that leads to each first."""
    found: dict[str, str] = {}
    level = {word: ""}
    for _ in range(3):
        nxt: dict[str, str] = {}
        for text, kind in level.items():
            for name in UTF8_READ_AS:
                other = from_utf8(text, name)
                if other != text and other != word and other not in found and not 0 < len(RARE.findall(other)) < RARE_TOGETHER:
                    nxt.setdefault(other, kind or f"utf-8>{name}")
        found |= nxt
        level = nxt
        if not level:
            break
    core = TAGS.sub("", word) if "<" in word or ">" in word else word
    beyond = sum(c > "\x7f" for c in core)
    if beyond >= MIN_SINGLE_BYTE and 2 * beyond >= len(core):
        for kind in _CROSS:
            if (other := crossed(word, kind)) is not None:
                found.setdefault(other, kind)
    return found


def crossed(word: str, kind: str) -> str | None:
    """``word`` under the single-byte chain ``kind``; None if it can't have come from it or is left as it is."""
    table = _CROSS[kind]
    if all(ord(c) in table for c in word if c > "\x7f"):
        other = word.translate(table)
        if other != word:
            return other
    return None


def suspicious(word: str) -> bool:
    """Whether the word is to be kept out of the training data: lost characters, or a plain chain leads to common ones.

    Right words may hold bytes that make UTF-8 by chance, but hardly ever such of a common script.
    """
    if LOST.search(word):
        return True
    for name in PLAIN:
        for run in SEQUENCES[name].findall(word):
            if (other := _decoded(run, name)) != run and COMMON.search(other):
                return True
    return False


def _grams(word: str) -> Iterator[tuple[int, int, int]]:
    a, b = 2, 2
    for c in (*map(ord, word), 3):
        yield a, b, c
        a, b = b, c


def _slots(a: int, b: int, c: int) -> tuple[int, int, int, int]:
    """Slots of (c), (b), (b, c) and (a, b) with (a, b, c) left to :func:`_slot3`."""
    return (c * 40503 + 11) % TABLE, (b * 48271 + 7 * 65537) % TABLE, (b * 69621 + c * 16807 + 5) % TABLE, (a * 69621 + b * 16807 + 3) % TABLE


def _slot3(a: int, b: int, c: int) -> int:
    return (a * 1103515245 + b * 22695477 + c * 134775813 + 1) % TABLE


class CharModel:
    """Interpolated trigram log-probabilities from the five hashed count tables."""

    def __init__(self, tables: np.ndarray, margins: dict[str, float] | None = None):
        self.uni, self.ctx, self.bi, self.ctx2, self.tri = (t.tolist() for t in tables)
        self.total = float(tables[0].sum()) + 1.0
        self.margins = margins or {}
        self.cache: dict[str, tuple[str, str]] = {}

    def score(self, word: str) -> float:
        out = 0.0
        for a, b, c in _grams(word):
            u, x, y, z = _slots(a, b, c)
            p1 = (self.uni[u] + 0.01) / (self.total + 0.01 * 65536)
            p2 = (self.bi[y] + 4.0 * p1) / (self.ctx[x] + 4.0)
            out += log((self.tri[_slot3(a, b, c)] + 4.0 * p2) / (self.ctx2[z] + 4.0))
        return out

    def weight(self, word: str) -> float:
        """Log frequency of the word's trigrams: unlike conditional probabilities, low where a whole script habit is rare."""
        return sum(log(self.tri[_slot3(a, b, c)] + 0.1) for a, b, c in _grams(word))

    def gain(self, word: str, other: str, kind: str) -> float:
        """Log-likelihood gained by reading ``other``; readings of equal length compare by trigram frequency."""
        measure = self.score if kind.startswith("utf-8") else self.weight
        return measure(other) - measure(word)

    def best(self, word: str) -> tuple[str, str, float]:
        """Likeliest reading, its kind and its gain over the stored word; the kind is empty if there is no other reading."""
        top = (word, "", 0.0)
        for other, kind in readings(word).items():
            gain = self.gain(word, other, kind) - self.margins.get(kind, 0.0)
            if not top[1] or gain > top[2]:
                top = (other, kind, gain)
        return top

    def judge(self, word: str) -> tuple[str, str]:
        """``(reading, kind)``: an accepted reading with its kind, or the word itself with ``lost`` or an empty kind."""
        got = self.cache.get(word)
        if got is None:
            other, kind, gain = self.best(word)
            got = (other, kind) if kind and gain > 0 else (word, "lost" if LOST.search(word) else "")
            if len(self.cache) < CACHE:
                self.cache[word] = got
        return got


    def judge_record(self, text: str | None) -> list[tuple[int, str, str, str]]:
        """``(line, word, reading, kind)`` of every word of ``text`` that is garbled.

        Single-byte chains accepted for words of the record are then tried on all its other words. In a line every word for which the
        chain was accepted speaks for it, by ``LINE_ODDS``; in other lines it has to beat the chain's margin. Character references
        (``&#195;&#169;``) are read as the characters they stand for, so a wrong decoding that was escaped later is one too.
        """
        if not text or text.isascii() and "&" not in text:
            return []
        out, rest, chains = [], [], {}
        for number, line in enumerate(text.split("\n")):
            for raw, w in _stored_words(line):
                other, kind = self.judge(w)
                if kind in _CROSS:
                    chains.setdefault(kind, Counter())[number] += 1
                if kind and kind != "lost":
                    out.append((number, raw, other, kind))
                else:
                    rest.append((number, raw, w, kind))
        for number, raw, w, lost in rest:
            top = (0.0, raw, lost)
            for kind, lines in chains.items():
                if (other := crossed(w, kind)) is not None:
                    gain = self.gain(w, other, kind) + (LINE_ODDS * lines[number] if number in lines else -self.margins.get(kind, 0.0))
                    if gain > top[0]:
                        top = (gain, other, kind)
            if top[2]:
                out.append((number, raw, *top[1:]))
        return out


def _stored_words(line: str) -> Iterator[tuple[str, str]]:
    """``(stored, meant)``: the words of a line that hold characters beyond ASCII, as such or as character references."""
    if line.isascii() and "&" not in line:
        return
    for raw in SPLIT.split(line):
        w = html.unescape(raw) if "&" in raw else raw
        if not w.isascii():
            yield raw, w


def _words(text: str | None) -> Iterator[str]:
    if text and not text.isascii():
        for line in text.split("\n"):
            if not line.isascii():
                yield from (w for w in SPLIT.split(line) if not w.isascii())


def _held(text: str) -> bool:
    return crc32(text.encode("utf-8", "replace")) % HELD_OUT == 0


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    kept: set[str] = set()
    known: dict[str, bool] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = list(_words(text))
            clean = True
            for w in set(words):
                if w not in known:
                    if len(known) > CACHE:
                        known.clear()
                    known[w] = suspicious(w)
                if known[w]:
                    clean = False
                    break
            if clean and words:
                if _held(text):
                    kept.update(words)
                else:
                    counts.update(words)
    tables = np.zeros((5, TABLE), np.int64)
    for word, n in counts.items():
        for a, b, c in _grams(word):
            u, x, y, z = _slots(a, b, c)
            tables[0, u] += n
            tables[1, x] += n
            tables[2, y] += n
            tables[3, z] += n
            tables[4, _slot3(a, b, c)] += n
    used = np.flatnonzero(tables.reshape(-1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(tables.reshape(-1)[used]), pa.nulls(len(used), pa.string())], names=["slot", "n", "word"])
    words = sorted(kept)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array([1] * len(words), pa.int64()), pa.array(words, pa.string())], names=["slot", "n", "word"])


def train(df: DataFrame, columns: list[str]) -> CharModel:
    """The model of all clean values of ``columns``, with its margins.

    The margin of a kind of chain is the ``QUANTILE`` of its gains over the distinct words of held-out clean records to
    which it applies, at least 0; the held-out words are scored where they lie and come back as one histogram per kind. A word that
    prefers the other reading by more than ``OUTLIER`` counts as garbled itself (single-byte mix-ups pass the first sieve).
    """
    texts = None
    for c in columns:
        one = df.select(F.col(c).alias("text")).where(F.col("text").isNotNull())
        texts = one if texts is None else texts.unionByName(one)
    return train_texts(texts)


def train_texts(texts: DataFrame) -> CharModel:
    """:func:`train` for the single column of ``texts``."""
    from webrank.plans.session import materialize

    parts = materialize(texts.mapInArrow(_train, "slot bigint, n bigint, word string"))
    rows = parts.where("word is null").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros(5 * TABLE, np.int64)
    tables[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    tables = tables.reshape(5, TABLE)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharModel(tables)
        hist: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                best: dict[str, float] = {}
                for other, kind in readings(word).items():
                    best[kind] = max(best.get(kind, -1e9), model.gain(word, other, kind))
                hist.update((k, max(-1, min(400, int(g * 4) + 1 if g > 0 else -1))) for k, g in best.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hist], pa.string()), pa.array([g for _, g in hist], pa.int32()), pa.array(list(hist.values()), pa.int64())], names=["kind", "gain", "n"])

    held = parts.where("word is not null").select("word").distinct()
    hist = held.mapInArrow(gains, "kind string, gain int, n bigint").groupBy("kind", "gain").agg(F.sum("n").alias("n")).toPandas()
    margins: dict[str, float] = {}
    for kind, part in hist.groupby("kind"):
        part = part[part["gain"] <= OUTLIER * 4].sort_values("gain")
        if part.empty:
            continue
        at = int(np.searchsorted(part["n"].cumsum().to_numpy(), QUANTILE * part["n"].sum()))
        margins[kind] = max(0.0, part["gain"].iloc[min(at, len(part) - 1)] / 4)
    return CharModel(tables, margins)


def find_garbled(df: DataFrame, keep: list[str], text: str, model: CharModel, restore: bool = False) -> DataFrame:
    """Rows whose ``text`` was decoded wrongly at least in part: ``keep``, ``n_words`` garbled and ``n_lost`` of them.

    With ``restore`` also ``restored``, the text with every accepted reading put in; words that lost characters stay as
    they are. Null and empty texts are never cases. Words are split at space, tab, CR and LF and searched in full.
    """
    tables = np.array([model.uni, model.ctx, model.bi, model.ctx2, model.tri])
    margins = model.margins
    slim = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = CharModel(tables, margins).judge_record
        for batch in batches:
            rows, garbled, lost, fixed = [], [], [], []
            for i, value in enumerate(batch.column("__text").to_pylist()):
                found = judge(value)
                if found:
                    rows.append(i)
                    garbled.append(len(found))
                    lost.append(sum(bool(LOST.search(other)) for _, _, other, _ in found))
                    if restore:
                        change = {(number, w): other for number, w, other, kind in found if kind != "lost"}
                        lines = value.split("\n")
                        for number in {k for k, _ in change}:
                            lines[number] = re.sub("[^ \t\r\n]+", lambda x, k=number: change.get((k, x.group()), x.group()), lines[number])
                        fixed.append("\n".join(lines))
            out = batch.select(keep).take(pa.array(rows, pa.int64()))
            out = out.append_column("n_words", pa.array(garbled, pa.int64())).append_column("n_lost", pa.array(lost, pa.int64()))
            yield out.append_column("restored", pa.array(fixed, pa.string())) if restore else out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text")
    return slim.mapInArrow(run, f"{fields}, n_words bigint, n_lost bigint" + (", restored string" if restore else ""))
