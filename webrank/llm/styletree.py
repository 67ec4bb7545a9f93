"""Keeping the main body of pages: site style trees, and their carry-over to pages stored without markup.

The DOMs of one host are merged into a style tree. Presentation nodes are the containers of its pages, each named by the tags
and attributes on the way to it; content nodes are the texts below them (digits and the site's own name masked). A presentation node
has as many styles as there are sequences of children on the pages that have it. With m pages its own importance is the
entropy of the styles to the base m, and a content node's is one minus the entropy of its spread over the host's
pages, 0 for a text once on every page, or over all pages where that is lower. The host's own spread counts less the fewer pages it has.
The composite importance of a presentation node with k styles is (1 - DAMPING**k) of its own and DAMPING**k of the mean
importance of the texts below it, weighted by length, over all pages of the host.

A page is cut from its root down. Where a node's branches hold more important text than the node itself, branches compete: those of
least ``SIBLING`` of the best one's important text, weighted by composite importance, stay. Elsewhere the node's own
texts are main text, and of its branches those of a composite importance below ``LOW`` are removed.

Stored pages are lines without containers. A line that is a content node of its host's tree, host and words alike, is furniture where
the tree always removes it; what the trees say about all other lines is carried over by counts: which words and
shapes occur in removed branches, headings, paragraphs and low-importance inserts of main branches. A page is read as
removed lines, then the body from its heading on, then removed lines, by the likeliest such sequence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm.linecodes import ANCHOR, ANY_TAG, KINDS, MARK, NODE, Lines, Table, slices, small
from webrank.operators.skew import counted_join
from webrank.plans.session import materialize

FURNITURE, HEADING, BODY, INSERT = range(4)
OPEN = -1
LOW = 0.5
LONG_TEXT = 100
SIBLING = 0.5
DAMPING = 0.9
STRENGTH = 4.0
#: The scores of a content node that the tree of the page's own host always removes: they outweigh the words of a line. What a
#: tree keeps may be an insert, so there the words decide.
REMOVED = (0.0, -1e3, -1e3, -1e3)
#: With this many pages a host's own spread counts half: its few pages may be copies of one another.
HOST_PAGES = 4
#: At most this many names have their weights in memory, the commonest ones; those of all others are joined to the lines that have them.
MODEL_NAMES = 1 << 21
#: Weights are multiples of one in this many, so that their sums are exact in any order.
GRID = 1 << 18
#: The weights of the rarer names of each line of a page, added up.
RARE = "array<struct<line: int, s0: double, s1: double, s2: double, s3: double>>"
#: At most this many bits tell which names may be among the rarer ones.
NAME_BITS = 1 << 28
STRUCTURE = frozenset("div nav main article section aside footer header form ul ol dl table tbody thead tr td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 b strong".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
BODY_TAG = re.compile(r"<body\b[^>]*>", re.I)
PAGE_SCHEMA = (
    "id bigint, host string, line_no array<int>, node array<int>, heading array<boolean>, key array<bigint>, size array<int>, "
    "parent array<int>, node_key array<bigint>, style array<bigint>, texts array<string>"
)


def site_name(host: str | None) -> str:
    """The label of a host name that names its site, in lower case: the last but one."""
    parts = (host or "").split(".")
    return (parts[-2] if len(parts) > 1 else parts[0]).lower()


def hash64(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def masked(text: str, site: str) -> str:
    """``text`` with digits and the words that are the site's name masked."""
    text = re.sub(r"\d+", "#", text)
    return re.sub(rf"(?i)\b{re.escape(site)}\b", "@", text) if len(site) > 2 else text


def line_text(line: str) -> str:
    """The text of a line, tags removed but for a mark at each anchor, white space collapsed."""
    if "<" not in line:
        return " ".join(line.split())
    return " ".join(ANY_TAG.sub("", ANCHOR.sub(f" {MARK} ", line)).replace("\r", "").split())


def dom_tree(value: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, bool, str]]]:
    """``(nodes, lines)`` of a document's body: ``(parent, signature)`` of each container, the root first, and
    ``(line number, container, heading, text)`` of each line that has text.

    A line belongs to the innermost container that is open at its beginning and at its end. Scripts and styles are left out.
    """
    nodes: list[tuple[int, str]] = [(-1, "")]
    lines: list[tuple[int, int, bool, str]] = []
    stack: list[tuple[str, int]] = []
    in_body = not BODY_TAG.search(value)
    skip = ""
    for number, line in enumerate(value.split("\n")):
        if not in_body:
            opening = BODY_TAG.search(line)
            if not opening:
                continue
            in_body, line = True, line[opening.end() :]
        if skip:
            end = re.search(rf"(?i)</{skip}\s*>", line)
            if not end:
                continue
            skip, line = "", line[end.end() :]
        low = line.lower()
        for name in ("script", "style"):
            if f"<{name}" in low:
                line = re.sub(rf"(?is)<{name}\b.*?</{name}\s*>", "", line)
                if rest := re.search(rf"(?is)<{name}\b", line):
                    skip, line = name, line[: rest.start()]
        before = [i for _, i in stack]
        heading = False
        for m in TAG.finditer(line):
            tag = m.group(2).lower()
            heading |= tag in HEADINGS
            if tag not in STRUCTURE:
                continue
            if m.group(1):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                nodes.append((stack[-1][1] if stack else 0, f"{tag} {' '.join(m.group(3).split())}".strip()))
                stack.append((tag, len(nodes) - 1))
        text = line_text(html.unescape(line) if "&" in line else line)
        if text.replace(MARK, "").strip():
            open_ = {i for _, i in stack}
            lines.append((number, next((i for i in reversed(before) if i in open_), 0), heading, text))
    return nodes, lines


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    kinds += [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    names = [x.split(" ")[0] for x in PAGE_SCHEMA.split(", ")]
    for batch in small(batches):
        rows = []
        for i, host, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
            site = site_name(host)
            nodes, lines = dom_tree(value)
            keys, children = [], [[] for _ in nodes]
            for n, (parent, sig) in enumerate(nodes):
                keys.append(hash64(f"{keys[parent]}>{sig}") if n else 0)
                if n:
                    children[parent].append(f"\x02{sig}")
            for _, node, heading, _ in lines:
                children[node].append("h" if heading else "t")
            # a style: the sequence of a node's children, each run of like ones told once
            styles = [hash64("\x03".join(x for j, x in enumerate(c) if not j or c[j - 1] != x)) for c in children]
            content = [hash64(masked(t, site)) for _, _, _, t in lines]
            no, node, head, texts = ([x[k] for x in lines] for k in range(4))
            rows.append((i, host or "", no, node, head, content, [len(t) for t in texts], [p for p, _ in nodes], keys, styles, texts))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _importance(n: str, total: str, spread: str) -> F.Column:
    """One minus the entropy, to the base of ``n`` pages, of ``total`` occurrences with ``spread`` the sum of c log c."""
    entropy = F.log(F.col(total).cast("double")) - F.col(spread) / F.col(total)
    return F.when(F.col(n) > 1, F.greatest(F.lit(0.0), 1 - entropy / F.log(F.col(n).cast("double")))).otherwise(1.0)


def _contents(pages: DataFrame) -> DataFrame:
    """``(host, key, n, local, whole)``: the importance of each text within its host and over all pages."""
    held = pages.select("id", "host", F.explode("key").alias("key")).groupBy("id", "host", "key").agg(F.count(F.lit(1)).alias("c"))
    sums = [F.sum("c").alias("t"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s")]
    by_host = materialize(held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), *sums))
    everywhere = by_host.groupBy("key").agg(F.count(F.lit(1)).alias("hosts"), F.sum("t").alias("ta"), F.sum("s").alias("sa"))
    everywhere = materialize(everywhere)
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    texts_of = materialize(by_host.groupBy("host").agg(F.count(F.lit(1)).alias("texts")).join(of_host, "host"))
    of_all = pages.agg(F.count(F.lit(1)).alias("of_all"))
    rows = counted_join(counted_join(by_host, texts_of, ["host"], "texts"), everywhere, ["key"], "hosts").join(F.broadcast(of_all))  # one row
    trust = F.col("of_host") / (F.col("of_host") + HOST_PAGES)
    local = 1 - (1 - _importance("of_host", "t", "s")) * trust
    return rows.select("host", "key", "n", local.alias("local"), _importance("of_all", "ta", "sa").alias("whole"))


def _nodes(folded: DataFrame, pages: DataFrame) -> DataFrame:
    """``(host, node_key, m, weight)``: the composite importance of each presentation node of each host's tree."""
    cells = pages.select("host", F.explode(F.arrays_zip("node_key", "style")).alias("x")).select("host", "x.*")
    styles = cells.groupBy("host", "node_key", "style").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    shown = styles.groupBy("host", "node_key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("s"))
    texts = folded.select("host", F.explode(F.arrays_zip("node_key", "gain", "mass")).alias("x")).select("host", "x.*")
    texts = texts.groupBy("host", "node_key").agg((F.sum("gain") / F.greatest(F.sum("mass"), F.lit(1.0))).alias("texts"))
    own = F.when(F.col("m") > 1, (F.log(F.col("m").cast("double")) - F.col("s") / F.col("m")) / F.log(F.col("m").cast("double"))).otherwise(1.0)
    damped = F.pow(F.lit(DAMPING), F.col("k"))
    return shown.join(texts, ["host", "node_key"]).select("host", "node_key", "m", ((1 - damped) * own + damped * F.col("texts")).alias("weight"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the important text and the length of text below every node of a page."""
    for batch in small(batches):
        rows = batch.to_pylist()
        out: dict[str, list] = {"gain": [], "mass": [], "important": [], "whole": []}
        for r in rows:
            found = {x["key"]: x for x in r["found"]}
            gain, mass = [0.0] * len(r["parent"]), [0.0] * len(r["parent"])
            whole = [found[k]["whole"] for k in r["key"]]
            important = [min(found[k]["local"], found[k]["whole"]) for k in r["key"]]
            for node, size, x in zip(r["node"], r["size"], important):
                gain[node] += x * size
                mass[node] += size
            for n in range(len(gain) - 1, 0, -1):
                gain[r["parent"][n]] += gain[n]
                mass[r["parent"][n]] += mass[n]
            for name, x in (("gain", gain), ("mass", mass), ("important", important), ("whole", whole)):
                out[name].append(x)
        kept = batch.select(["id", "host", "line_no", "node", "heading", "size", "parent", "node_key"])
        for name, values in out.items():
            kept = kept.append_column(name, pa.array(values, pa.list_(pa.float64())))
        yield kept


def kept_nodes(parent: list[int], gain: list[float], weight: list[float]) -> set[int]:
    """The nodes whose own lines are main text, from the important text below each and their composite importance."""
    children: list[list[int]] = [[] for _ in parent]
    for n in range(1, len(parent)):
        children[parent[n]].append(n)
    kept, open_ = set(), [0]
    while open_:
        n = open_.pop()
        branches = [c for c in children[n] if gain[c] > 0]
        own = gain[n] - sum(gain[c] for c in branches)
        scores = [gain[c] * weight[c] for c in branches]
        best = max(range(len(branches)), key=lambda i: (scores[i], -branches[i]), default=None)
        if best is not None and gain[branches[best]] > own:
            open_ += [c for i, c in enumerate(branches) if i == best or scores[i] >= SIBLING * scores[best] and weight[c] >= LOW]
        else:
            kept.add(n)
            open_ += [c for c in branches if weight[c] >= LOW]
    return kept


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The label of every line of a page, and whether it is main text."""
    for batch in small(batches):
        labels, mains = [], []
        for r in batch.to_pylist():
            found = {x["node_key"]: x["weight"] for x in r["found"]}
            weight = [found.get(k, 0.0) for k in r["node_key"]]
            kept = kept_nodes(r["parent"], r["gain"], weight)
            main = [n in kept for n in r["node"]]
            heads = any(h for h, inside in zip(r["heading"], main) if inside)
            label, first = [], True
            for inside, heading, size, whole in zip(main, r["heading"], r["size"], r["whole"]):
                if not inside:
                    label.append(FURNITURE)
                elif heading or first:
                    label.append(HEADING)
                elif whole >= LOW or size >= LONG_TEXT:
                    label.append(BODY)
                else:
                    label.append(INSERT if heads else OPEN)
                first &= not inside
            labels.append(label)
            mains.append(main)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(labels, pa.list_(pa.int32())), pa.array(mains, pa.list_(pa.bool_()))], names=["id", "label", "main"]
        )


def style_trees(pages: DataFrame) -> DataFrame:
    """``(id, host, line_no, texts, label, main)``, arrays over the lines of ``pages(id, host, html)`` that have text.

    ``label`` is one of the four line kinds, or ``OPEN`` where the tree leaves it: a short text of low importance over all pages, in a
    main branch that marks no headings, may be either a heading or an insert. ``main`` tells the lines of the main
    branches. A page is one row; rows with a null id or HTML are left out, a null host is a host of its own.
    """
    parsed = materialize(pages.where("html is not null and id is not null").select("id", "host", "html").mapInArrow(_parse, PAGE_SCHEMA))
    slim = parsed.drop("texts")
    contents = materialize(_contents(slim))
    cells = slim.select("id", "host", F.explode(F.array_distinct("key")).alias("key"))
    met = counted_join(cells, contents, ["host", "key"], "n").groupBy("id").agg(F.collect_list(F.struct("key", "local", "whole")).alias("found"))
    fields = ", ".join(x for x in PAGE_SCHEMA.split(", ") if x.split(" ")[0] not in ("key", "style", "texts"))
    schema = f"{fields}, gain array<double>, mass array<double>, important array<double>, whole array<double>"
    folded = materialize(slim.join(met, "id").mapInArrow(_folded, schema))
    nodes = materialize(_nodes(folded, slim))
    cells = folded.select("id", "host", F.explode(F.array_distinct("node_key")).alias("node_key"))
    met = counted_join(cells, nodes, ["host", "node_key"], "m").groupBy("id").agg(F.collect_list(F.struct("node_key", "weight")).alias("found"))
    slim = folded.select("id", "line_no", "node", "heading", "size", "parent", "node_key", "gain", "whole")
    cut = slim.join(met, "id").mapInArrow(_cut, "id bigint, label array<int>, main array<boolean>")
    return materialize(parsed.select("id", "host", "line_no", "texts").join(cut, "id"))


class LineModel:
    """Log-likelihoods of the four kinds of lines from counts of names, and the sequence model over a page."""

    #: Log-probabilities of moving between furniture before, heading, body, insert and furniture after. A heading hardly ever
    #: follows another, so titles of teasers in front of the page's own are not taken for headings.
    MOVES = np.log(
        np.array(
            [
                [0.93, 0.06, 1e-5, 1e-40, 0.01],
                [1e-40, 0.001, 0.95, 0.039, 0.01],
                [1e-40, 0.08, 0.76, 0.06, 0.10],
                [1e-40, 0.20, 0.60, 0.10, 0.10],
                [1e-40, 1e-40, 1e-40, 1e-40, 1.0],
            ]
        )
    ).tolist()

    def __init__(self, keys: np.ndarray, like: np.ndarray, rest: DataFrame | None = None):
        self.keys, self.like, self.rest = keys, like, rest
        self.table = Table(keys, like)

    def scores(self, lines: Lines, hosts: list[str | None] | None = None, rare: pa.ListArray | None = None) -> np.ndarray:
        """Log-likelihood of furniture, heading, body and insert of each line, up to a common constant.

        ``rare`` are the weights of rarer names for each page, as :func:`with_rare` gives them; without them the names in memory count.
        """
        out = self.table.sums(*lines.names(hosts), lines.n_lines).astype(np.float64, copy=False)  # counts of nothing are integers
        if rare is not None and rare.null_count < len(rare):
            sizes = rare.value_lengths().fill_null(0).to_numpy()
            line, *weights = (x.to_numpy() for x in rare.flatten().flatten())
            out[line + np.repeat(lines.first_line, sizes)] += np.stack(weights, axis=1)
        return out

    def known(self, lines: Lines, hosts: list[str | None]) -> np.ndarray:
        """Whether each line is a content node, one in memory, that its host's tree always removes."""
        line, keys = lines.names(hosts)
        node = keys % np.uint64(KINDS) == NODE
        found = self.table.find(keys[node])
        out = np.zeros(lines.n_lines, bool)
        out[line[node]] = self.table.used[found] & (self.table.rows[found, BODY] < 0)
        return out

    def kinds(self, scores: list[list[float]]) -> list[int]:
        """The likeliest kinds of the lines of a page in order: furniture, body with headings and inserts, furniture."""
        if not scores:
            return []
        m = self.MOVES
        (m00, m01, m02, _, _), m1, m2, m3, _ = m
        f, h, b, p = scores[0]
        s0, s1, s2, s3, s4 = f, h - 3.0, b - 12.0, p - 30.0, f - 30.0
        back = []
        for f, h, b, p in scores[1:]:
            # best way into heading, body, insert and furniture after, from heading, body and insert
            k1, v1 = 1, s1 + m1[1]
            k2, v2 = 1, s1 + m1[2]
            k3, v3 = 1, s1 + m1[3]
            k4, v4 = 1, s1 + m1[4]
            for k, s, mk in ((2, s2, m2), (3, s3, m3)):
                if s + mk[1] > v1:
                    k1, v1 = k, s + mk[1]
                if s + mk[2] > v2:
                    k2, v2 = k, s + mk[2]
                if s + mk[3] > v3:
                    k3, v3 = k, s + mk[3]
                if s + mk[4] > v4:
                    k4, v4 = k, s + mk[4]
            if s0 + m01 > v1:
                k1, v1 = 0, s0 + m01
            if s0 + m02 > v2:
                k2, v2 = 0, s0 + m02
            if s4 > v4:
                k4, v4 = 4, s4
            back.append((0, k1, k2, k3, k4))
            s0, s1, s2, s3, s4 = s0 + m00 + f, v1 + h, v2 + b, v3 + p, v4 + f
        last = (s0, s1, s2, s3, s4)
        at = last.index(max(last))
        out = [FURNITURE] * len(scores)
        for n in range(len(scores) - 1, -1, -1):
            out[n] = (FURNITURE, HEADING, BODY, INSERT, FURNITURE)[at]
            if n:
                at = back[n - 1][at]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts, labels, hosts = (batch.column(k).to_pylist() for k in range(3))
        pages = ["\n".join(x) for x in texts]
        for at, end in slices(pages):
            kind = np.array([k for x in labels[at:end] for k in (x or [OPEN])], np.int64)  # a page without lines is one empty line
            line, keys = Lines(pages[at:end]).names(hosts[at:end])
            known = kind[line] >= 0
            names, where = np.unique(keys[known], return_inverse=True)
            counts = np.bincount(where * 4 + kind[line][known], minlength=4 * len(names)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(counts[:, k]) for k in range(4))], names=["name", "c0", "c1", "c2", "c3"])


def name_weights(keys: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The weights of names that occur ``counts`` times in lines of each label; names of one kind share its ``totals`` among them."""
    kind = (keys.astype(np.uint64) % np.uint64(KINDS)).astype(np.int64)
    prior = (totals / totals.sum(axis=1, keepdims=True))[kind]
    seen = counts.sum(axis=1, keepdims=True)
    like = np.round(np.log((counts + STRENGTH * prior) / (seen + STRENGTH) / prior) * GRID) / GRID
    like[kind == NODE] = np.where(counts[kind == NODE, FURNITURE] == seen[kind == NODE, 0], 1.0, 0.0)[:, None] * np.array(REMOVED)
    return like.astype(np.float32)


def _columns(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``(names, counts)`` of rows of ``(name, c0, c1, c2, c3)``."""
    counts = np.empty((table.num_rows, 4))
    for k in range(4):
        counts[:, k] = table.column(f"c{k}").to_numpy()
    return table.column("name").to_numpy().view(np.uint64), counts


def line_model(labelled: DataFrame, max_names: int = MODEL_NAMES) -> LineModel:
    """The model of all lines of ``labelled(texts, label, host)`` that have a label.

    Every name is counted over all of them, and every name seen twice has weights. Where those are more than ``max_names``, the
    driver gets the names seen so often that no more remain, that many rows of five numbers at most; the weights of all others
    stay in the model's ``rest(name, s0, s1, s2, s3)``, and :func:`with_rare` joins them to the lines.
    """
    rows = labelled.select("texts", "label", "host").mapInArrow(_count, "name bigint, c0 bigint, c1 bigint, c2 bigint, c3 bigint")
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]
    counts = rows.groupBy("name").agg(*sums).withColumn("t", F.expr("c0 + c1 + c2 + c3")).where("t >= 2")
    counts = materialize(counts)
    totals = np.ones((KINDS, 4))
    for r in counts.groupBy(F.col("name").bitwiseAND(KINDS - 1).alias("kind")).agg(*sums).collect():
        totals[r.kind] += [r.c0, r.c1, r.c2, r.c3]
    # different counts are few: n of them stand for n * n / 2 occurrences at least
    sizes = dict(zip(*(x.to_pylist() for x in counts.groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow().columns)))
    room, least = max_names, 2
    for t in sorted(sizes, reverse=True):
        if sizes[t] > room:
            least = t + 1
            break
        room -= sizes[t]
    keys, table = _columns(counts.where(F.col("t") >= least).toArrow())
    rest = None
    if least > 2:

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                like = name_weights(*_columns(batch), totals)
                yield pa.RecordBatch.from_arrays([batch.column("name"), *(pa.array(like[:, k]) for k in range(4))], names=["name", "s0", "s1", "s2", "s3"])

        rest = materialize(counts.where(F.col("t") < least).drop("t").mapInArrow(weigh, "name bigint, s0 float, s1 float, s2 float, s3 float"))
    return LineModel(keys, name_weights(keys, table, totals), rest)


def _name_bits(names: DataFrame) -> tuple[np.ndarray, int]:
    """``(bits, shift)``: the bit at ``key >> shift`` is set for every key of ``names(name)``, and for few others."""
    size = min(NAME_BITS, 1 << max(6, (8 * names.count()).bit_length()))
    shift = 65 - size.bit_length()
    at = F.shiftrightunsigned("name", shift)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {shift}) & 63 as int))")
    rows = names.groupBy(F.shiftrightunsigned(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits, shift


def with_rare(df: DataFrame, ids: list[str], value: str, read: Callable[[object], str], model: LineModel) -> DataFrame:
    """``df(*ids, value, host)`` with the column ``rare`` of the weights of names that ``model`` doesn't hold in memory.

    ``read`` makes a page's text of its ``value``. Rows of the same ``ids`` must have the same text and host; ids must not be null.
    Names that many lines have are broadcast, all others joined by a shuffle.
    """
    if model.rest is None:
        return df.withColumn("rare", F.lit(None).cast(RARE))
    keys, like = model.keys, model.like
    bits, shift = _name_bits(model.rest)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*ids).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(keys, like)
        for batch in small(batches):
            values, hosts = [read(x) for x in batch.column(len(ids)).to_pylist()], batch.column(len(ids) + 1).to_pylist()
            for at, end in slices(values):
                lines = Lines(values[at:end])
                line, names = lines.names(hosts[at:end])
                place = names >> np.uint64(shift)
                likely = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                likely = likely[~table.used[table.find(names[likely])]]
                line, names = line[likely], names[likely]
                order = np.lexsort((names, line))
                line, names = line[order], names[order]
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (names[1:] != names[:-1])
                first = np.flatnonzero(new)
                line, names, times = line[first], names[first], np.diff(np.append(first, len(new)))
                page = lines.page[line]
                of = pa.array(page + at)
                cols = [batch.column(k).take(of) for k in range(len(ids))]
                cols += [pa.array((line - lines.first_line[page]).astype(np.int32)), pa.array(names.view(np.int64)), pa.array(times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*ids, "line", "name", "times"])

    cells = materialize(df.select(*ids, value, "host").mapInArrow(run, ", ".join([*columns, "line int", "name bigint", "times int"])))
    met = materialize(model.rest.join(cells.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name"))
    found = counted_join(cells, met, ["name"], "n").where("s0 is not null")
    # a page may be there several times; all three groupings share one shuffle
    once = found.repartition(*ids).dropDuplicates([*ids, "line", "name"])
    sums = once.groupBy(*ids, "line").agg(*[F.sum(F.col("times") * F.col(f"s{k}").cast("double")).alias(f"s{k}") for k in range(4)])
    rare = sums.groupBy(*ids).agg(F.collect_list(F.struct("line", "s0", "s1", "s2", "s3")).alias("rare"))
    return df.join(rare, ids, "left")
