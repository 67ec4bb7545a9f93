"""Main text of crawled pages: style trees of the HTML at hand, line models for stored pages, and spam left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrank.llm import prose, styletree
from webrank.llm.linecodes import Lines, plain, sequences, slices, small
from webrank.plans.session import materialize


@dataclass
class Read:
    """``pages(crawl_id, main, prose_share, n_tokens, perplexity, spam)``, the labelled HTML lines and the line model."""

    pages: DataFrame
    labelled: DataFrame
    lines: styletree.LineModel


def _host() -> Column:
    return F.coalesce("host", F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def host_of(df: DataFrame) -> DataFrame:
    """``(id, host)`` of the crawled rows, the host from the URL where it is null."""
    return df.where("crawl_id is not null").groupBy(F.col("crawl_id").alias("id")).agg(F.max(_host()).alias("host"))


def _reader(lines: styletree.LineModel, model: prose.ProseModel, text: bool):
    keys, like, (words, tables, band) = lines.keys, lines.like, (model.words, model.tables, model.band)
    fallback = not len(keys) and lines.rest is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, scorer = styletree.LineModel(keys, like), prose.ProseModel(words, tables, band)
        for batch in small(batches):
            ids, prints, values, hosts = (batch.column(k).to_pylist() for k in range(4))
            rare = batch.column(4)
            for at, end in slices(values):
                part = Lines([plain(x) for x in values[at:end]])
                n = end - at
                scores = reader.scores(part, hosts[at:end], rare.slice(at, n))
                filled = np.flatnonzero(part.filled)
                bounds = np.searchsorted(part.page[filled], np.arange(n + 1))
                wanted, mains = np.zeros(part.n_lines, bool), []
                rows = scores[filled].tolist()
                for k in range(n):
                    places = filled[bounds[k] : bounds[k + 1]]
                    if fallback:
                        kept = np.arange(part.first_line[k], part.first_line[k] + np.count_nonzero(part.page == k))
                    else:
                        kinds = np.array(reader.kinds(rows[bounds[k] : bounds[k + 1]]), np.int64)
                        kept = places[(kinds == styletree.HEADING) | (kinds == styletree.BODY)]
                        if not np.any(kinds == styletree.BODY):  # a heading is no body: all lines are judged
                            wanted[places] = True
                    wanted[kept] = True
                    mains.append((kept - part.first_line[k]).astype(np.int32))
                line, codes = sequences(*part.tokens(scorer.vocabulary), wanted)
                share, size = scorer.prose(line, codes, part.page, n)
                cuts = np.searchsorted(part.page[line], np.arange(n + 1))
                cols = [pa.array(ids[at:end], pa.int64()), pa.array(prints[at:end], pa.int64()), pa.array(mains, pa.list_(pa.int32()))]
                cols += [pa.array(share), pa.array(size), pa.array([codes[cuts[k] : cuts[k + 1]].tobytes() for k in range(n)], pa.binary())]
                names = ["crawl_id", "fp", "main", "prose_share", "n_tokens", "codes"]
                if text:
                    split = [x.split("\n") for x in values[at:end]]
                    cols.append(pa.array(["\n".join(split[k][i] for i in mains[k]) for k in range(n)], pa.string()))
                    names.append("main_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _scored(model: prose.ProseModel, keep: list[str]):
    words, tables, ends = model.words, model.tables, model.pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = prose.ProseModel(words, tables, pages=ends)
        for batch in prose.few(batches):
            means = scorer.means(*prose.joined(batch.column("codes")), batch.num_rows)
            odd = scorer.abnormal(means) & (batch.column("n_tokens").to_numpy() > 0)
            yield batch.select(keep).append_column("perplexity", pa.array(np.exp(-means))).append_column("spam", pa.array(odd))

    return run


def read_pages(crawl: DataFrame, raw_pages: DataFrame, prose_texts: DataFrame, text: bool = False) -> Read:
    """Reads every stored page of ``crawl(crawl_id, url, host, page)`` into its main lines and the perplexity of its body.

    The style trees come from ``raw_pages(crawl_id, html)``, the prose model from ``prose_texts(text)`` and the bodies
    that read as prose. Rows with a null id or page take no part; an id delivered several times gives one row, of the text
    of greatest hash where texts differ. A page in which no line but headings reads as body is judged by all its lines; an
    empty page has no main lines, a prose share of 1 and is no spam. Without any HTML every line counts as body.
    """
    raw = raw_pages.where("crawl_id is not null and html is not null").groupBy(F.col("crawl_id").alias("id")).agg(F.max("html").alias("html"))
    sited = raw.join(host_of(crawl.select("crawl_id", "host", "url")), "id", "left")
    labelled = styletree.style_trees(sited)
    lines = styletree.line_model(labelled)
    model = prose.train(prose_texts, "text", "lang" if "lang" in prose_texts.columns else None)
    schema = "crawl_id bigint, fp bigint, main array<int>, prose_share double, n_tokens bigint, codes binary" + (", main_text string" if text else "")
    stored = crawl.where("crawl_id is not null and page is not null").select(F.col("crawl_id").cast("bigint"), F.xxhash64("page").alias("fp"), "page", _host().alias("host"))
    stored = stored.withColumn("row", F.xxhash64("page", F.coalesce("host", F.lit(""))))
    stored = styletree.with_rare(stored, ["crawl_id", "row"], "page", plain, lines).select("crawl_id", "fp", "page", "host", "rare")
    read = stored.mapInArrow(_reader(lines, model, text), schema)
    rest = [c for c in read.columns if c != "crawl_id"]
    bodies = materialize(read.groupBy("crawl_id").agg(F.max(F.struct(*rest)).alias("x")).select("crawl_id", *[f"x.{c}" for c in rest if c != "fp"]))
    keep = ["crawl_id", "main", "prose_share", "n_tokens", *(["main_text"] if text else [])]
    fields = "crawl_id bigint, main array<int>, prose_share double, n_tokens bigint" + (", main_text string" if text else "")
    pages = bodies.mapInArrow(_scored(prose.second_step(model, bodies), keep), f"{fields}, perplexity double, spam boolean")
    return Read(pages, labelled, lines)


def main_lines(crawl: DataFrame, raw_pages: DataFrame, prose_texts: DataFrame) -> DataFrame:
    """``(field, crawl_id, line_no)``: lines of the main body of each ``page`` and ``html``; spam pages have none.

    Lines are those between line feeds, numbered from 0. In HTML they are the lines of the main branches of the page's tree
    but for those that read as inserts.
    """
    read = read_pages(crawl, raw_pages, prose_texts)
    pages = materialize(read.pages.select("crawl_id", "main", "spam"))
    flat = pages.where("not spam").select(F.lit("page").alias("field"), "crawl_id", F.explode("main").alias("line_no"))
    keys, like = read.lines.keys, read.lines.like

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = styletree.LineModel(keys, like)
        for batch in small(batches):
            ids, numbers, texts, labels, mains, hosts = (batch.column(k).to_pylist() for k in range(6))
            values = ["\n".join(x) for x in texts]
            rare = batch.column(6)
            for at, end in slices(values):
                part = Lines(values[at:end])
                scores = model.scores(part, hosts[at:end], rare.slice(at, end - at))
                out: tuple[list, list] = ([], [])
                for k in range(at, end):
                    first = part.first_line[k - at]
                    for j, (n, label, main) in enumerate(zip(numbers[k], labels[k], mains[k])):
                        _, h, b, p = scores[first + j]
                        if main and (label == styletree.HEADING or max(h, b) >= p):
                            out[0].append(ids[k])
                            out[1].append(n)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], names=["crawl_id", "line_no"])

    spam = pages.where("spam").select(F.col("crawl_id").alias("id"))
    held = read.labelled.join(spam, "id", "left_anti").select("id", "line_no", "texts", "label", "main", "host")
    held = styletree.with_rare(held, ["id"], "texts", "\n".join, read.lines).select(*held.columns, "rare")
    marked = held.mapInArrow(run, "crawl_id bigint, line_no int").select(F.lit("html").alias("field"), "crawl_id", "line_no")
    return flat.unionByName(marked)
