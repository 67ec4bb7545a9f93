"""Wrong encodings, main text, keyword pages and token sizes."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from webrank.llm import linecodes, mojibake, pages, prose, styletree, tokens

FRENCH = "Le théâtre de la forêt fut créé après l’été — où les élèves ont été mesurés à côté du château"
RUSSIAN = "Сегодня старый музей снова открыт и письма ведут туда каждое лето"
ENGLISH = "the old museum — isn’t far from the harbour of Brøda"


@pytest.fixture(scope="module")
def model(spark):
    texts = [(f"{x} {n}",) for n in range(60) for x in (FRENCH, RUSSIAN, ENGLISH)] + [(None,), ("",), ("plain",)]
    return mojibake.train_texts(spark.createDataFrame(texts, "text string"))


@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", [FRENCH, ENGLISH])
def test_utf8_read_as_another_set_is_restored(spark, model, read_as, text):
    table = mojibake.TABLES[read_as]
    back = {b: c for c, b in table.items()}
    garbled = "".join(chr(b) if b < 128 else back.get(b, "") for b in text.encode())
    lost = any(b >= 128 and b not in back for b in text.encode())
    df = spark.createDataFrame([(1, garbled), (2, text), (3, None), (4, "")], "id int, text string")
    found = mojibake.find_garbled(df, ["id"], "text", model, restore=True).collect()
    assert [r.id for r in found] == [1]
    if not lost:
        assert found[0].restored == text and found[0].n_lost == 0


def test_single_byte_sets_twice_garbled_and_lost(spark, model):
    double = FRENCH.encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")
    table = [(1, RUSSIAN.encode("cp1251").decode("cp1252")), (2, RUSSIAN.encode("cp1251").decode("koi8_r")), (3, double), (4, "caf� ouvert"), (5, RUSSIAN), (6, "SÃO (Ã and õ in spelling) € 40")]
    df = spark.createDataFrame(table, "id int, text string")
    found = {r.id: r for r in mojibake.find_garbled(df, ["id"], "text", model, restore=True).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert "музей" in found[1].restored and "музей" in found[2].restored and found[4].n_lost == 1 and found[4].restored == "caf� ouvert"


@pytest.mark.parametrize(("read_as", "written"), [("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r")])
def test_chain_of_a_record_reaches_its_short_and_glued_words(spark, model, read_as, written):
    text = f'{RUSSIAN}\n<a href="/a/long/path/to/it">музей</a> и лето\nи'
    df = spark.createDataFrame([(1, text.encode(written).decode(read_as)), (2, text)], "id int, text string")
    found = mojibake.find_garbled(df, ["id"], "text", model, restore=True).collect()
    assert [(r.id, r.restored) for r in found] == [(1, text)]
    glued = text.split()[12].encode(written).decode(read_as)
    assert "музей" in model.judge(glued)[0]


@pytest.mark.parametrize(("read_as", "written"), [("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866")])
def test_single_letters_and_chance_utf8_of_a_garbled_line_are_restored(spark, model, read_as, written):
    text = "Сегодня старый музей снова открыт и письма ведут туда, а лето каждое\nСегодня старый музей снова открыт"
    df = spark.createDataFrame([(1, text.encode(written).decode(read_as, "ignore"))], "id int, text string")
    assert mojibake.find_garbled(df, ["id"], "text", model, restore=True).first().restored == text
    assert "ޖ" not in mojibake.readings("Ìû")


def test_escaped_garbled_words_are_found_and_right_references_are_not(spark, model):
    garbled = "théâtre été".encode().decode("cp1252")
    escaped = "".join(f"&#{ord(c)};" if c > "\x7f" else c for c in garbled)
    right = "Le th&eacute;&acirc;tre de la for&#234;t & autres &amp; plus"
    df = spark.createDataFrame([(1, escaped), (2, right), (3, "plain & text"), (4, "&#195;&#169; &lt;b&gt;")], "id int, text string")
    found = {r.id: r.restored for r in mojibake.find_garbled(df, ["id"], "text", model, restore=True).collect()}
    assert found == {1: "théâtre été", 4: "é &lt;b&gt;"}


def test_garbled_search_on_empty_and_long_texts(spark, model):
    df = spark.createDataFrame([(1, ENGLISH * 5000 + " thÃ©Ã¢tre")], "id int, text string")
    assert rows(mojibake.find_garbled(df, ["id"], "text", model), "id", "n_words") == [(1, 1)]
    assert mojibake.find_garbled(df.where("false"), ["id"], "text", model).count() == 0
    empty = mojibake.train_texts(spark.createDataFrame([], "text string"))
    assert mojibake.find_garbled(df, ["id"], "text", empty).count() in (0, 1)


def test_dom_tree():
    page = "<html>\n<head><title>t</title></head>\n<body><p>start\n<div id=w>\n<nav>\n<a href='/a'>A</a>\n</nav>\n<div class='m'>\n<h1>Head &amp; more</h1>\n<p>text\n<br>\n<script>var x = '<div>';\n</script> after\nlast</p>\n</div>\n</div>\n</body>"
    nodes, lines = styletree.dom_tree(page)
    assert [(n, t.replace(linecodes.MARK, "").strip()) for n, _, _, t in lines] == [(2, "start"), (5, "A"), (8, "Head & more"), (9, "text"), (12, "after"), (13, "last")]
    assert [s for _, s in nodes] == ["", "div id=w", "nav", "div class='m'"] and [p for p, _ in nodes] == [-1, 0, 1, 1]
    assert [n for _, n, _, _ in lines] == [0, 2, 3, 3, 3, 3] and lines[2][2] and not lines[3][2]
    assert styletree.dom_tree("") == ([(-1, "")], []) and styletree.dom_tree("<body>\n<p>x</p>")[1][0][3] == "x"


def test_branches_are_cut_at_every_depth():
    #         root  wrap  main  teaser  list  aside
    parent = [-1, 0, 1, 2, 2, 1]
    gain = [1000.0, 1000.0, 900.0, 40.0, 260.0, 100.0]
    weight = [1.0, 0.9, 0.9, 0.2, 0.8, 0.9]
    assert styletree.kept_nodes(parent, gain, weight) == {2, 4}
    assert styletree.kept_nodes([-1, 0, 0, 0], [100.0, 50.0, 45.0, 5.0], [1.0, 0.9, 0.9, 0.9]) == {1, 2}
    assert styletree.kept_nodes([-1], [0.0], [1.0]) == {0}


def test_nested_furniture_is_removed_and_importance_is_entropy(spark):
    words = "harbour museum library castle meadow railway garden bridge tower canal".split()
    pages = []
    for i in range(40):
        body = [f"<p>The {words[i % 10]} of number {chr(97 + i % 26)}{chr(97 + i // 26)} stands near the old {words[i * 7 % 10]} and the {words[i * 3 % 10]} {i % 26 * 'x'}</p>" for _ in range(1 + i % 3)]
        teaser = ["<div class='ad'>", "Read our letter every week", "Follow the garden club", "</div>"]
        page = ["<body>", "<div class='all'>", "<div class='menu'>", "Home", "News", "</div>", "<div class='text'>", "<h1>Story " + chr(97 + i % 26) * (1 + i // 26) + "</h1>", *body[:1], *teaser, *body[1:], "</div>", "</div>", "<div class='foot'>", "Terms of use", "</div>", "</body>"]
        pages.append((i, "h.example", "\n".join(page)))
    df = spark.createDataFrame(pages, "id long, host string, html string")
    for r in styletree.style_trees(df).collect():
        kept = [t for t, m in zip(r.texts, r.main) if m]
        assert kept and kept[0].startswith("Story") and all(t.startswith(("Story", "The ")) for t in kept)
        assert len(kept) == 2 + r.id % 3
    empty = styletree.style_trees(df.where("false"))
    assert empty.count() == 0 and not len(styletree.line_model(empty).keys)


def test_lines_words_tokens_equal_plain_python():
    texts = ["The 12 cats, 3 dogs\n\n \x01 Menu é漢 #tag a_1b — x\r", "", "one\ttwo\u00a0three 1990s"]
    lines = linecodes.Lines(texts)
    flat = [x for t in texts for x in t.split("\n")]
    assert lines.n_words.tolist() == [len(x.split()) for x in flat] and lines.page.tolist() == [0, 0, 0, 1, 2]
    assert lines.filled.tolist() == [True, False, True, False, True]
    line, code = lines.tokens(linecodes.Vocabulary(["the", "The", ","]))
    got = {i: code[line == i].tolist() for i in range(5)}
    L, C, N, M, F_, S = range(6)
    assert got == {0: [9, N, L, 10, N, L], 1: [], 2: [S, C, F_, S, L, M, S, L], 3: [], 4: [L, L, L, M]}
    of, seq = linecodes.sequences(line, code, np.array([True, True, False, True, True]))
    assert seq.tolist() == [6, 6, 9, N, L, 10, N, L, 7, 6, 6, L, L, L, M, 7] and of.tolist() == [0] * 9 + [4] * 7


def test_every_word_of_a_long_line_counts():
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    a, b = " ".join(words), " ".join([*words[:200], "other", *words[201:]])
    names = [set(linecodes.Lines([x]).names()[1].tolist()) for x in (a, b)]
    assert len(names[0] - names[1]) == 3 and len(names[1] - names[0]) == 3  # the word and its two pairs
    assert len(names[0]) >= 400 + 399


def test_table_finds_all_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    table = linecodes.Table(keys, np.arange(len(keys), dtype=float)[:, None] + 1)
    found = table.sums(np.arange(len(keys)), keys, len(keys))[:, 0]
    assert found.tolist() == [float(i + 1) for i in range(len(keys))]
    assert not table.sums(np.zeros(5000, int), rng.integers(2**63, 2**64 - 1, 5000, dtype=np.uint64), 1).any()
    assert not linecodes.Table(np.zeros(0, np.uint64), np.zeros((0, 4))).sums(np.zeros(3, int), keys[:3], 1).any()


def corpus(spark):
    nouns = ["harbour", "museum", "library", "castle", "meadow", "railway", "garden", "bridge"]

    def sentence(i):
        a, b, c, d = (nouns[(i * k + k) % 8] for k in (1, 3, 5, 7))
        return f"The old {a} near the {b} was rebuilt in {1800 + i % 90} after the {c} had been closed by the {d}."

    crawl, raw, docs = [], [], []
    for i in range(120):
        host = f"www.site{i % 12}.example"
        body = [f"The story of {nouns[i % 8]} {i}"] + [sentence(i * 7 + j) + " " + sentence(i * 5 + 3 * j) for j in range(4)]
        if i % 20 == 7:
            body = [f"cheap {nouns[i % 8]} sale"] + ["cheap xanbu sale xanbu order zorbi cheap zorbi online xanbu sale zorbi xanbu buy zorbi"] * 5
        menu, foot = ["Home | News | Contact"], ["Terms of use", f"© {2000 + i % 20} Site{i % 12}"]
        crawl.append((i, f"https://{host}:443/p{i}", host if i % 9 else None, "\n".join(menu + body + foot)))
        markup = ["<html>", "<body>", "<nav>", f"<div>{menu[0]}</div>", "</nav>", "<article>", f"<h1>{body[0]}</h1>", *[f"<p>{x}</p>" for x in body[1:]], "</article>", "<footer>", *[f"<p>{x}</p>" for x in foot], "</footer>", "</body>", "</html>"]
        if i % 2:
            raw.append((i, "\n".join(markup)))
        docs.append((i, " ".join(sentence(i * 11 + j) for j in range(3)) + "\n" + sentence(i), "en"))
    crawl += [(500, None, None, None), (501, "https://a.b.example/", None, ""), (None, None, None, "x"), (3, *crawl[3][1:])]
    raw += [(None, "<p>x"), (900, None), (901, "")]
    docs += [(900, None, None), (901, "", "en")]
    return (
        spark.createDataFrame(crawl, "crawl_id long, url string, host string, page string").withColumn("id", F.lit(0)).withColumn("main", F.lit(0)),
        spark.createDataFrame(raw, "crawl_id long, html string").withColumn("id", F.lit("x")),
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
    )


def test_main_lines_and_spam(spark):
    crawl, raw, docs = corpus(spark)
    found = {}
    for r in pages.main_lines(crawl, raw, docs).collect():
        found.setdefault((r.field, r.crawl_id), set()).add(r.line_no)
    spam = {i for i in range(120) if i % 20 == 7}
    assert {i for f, i in found if f == "page"} == set(range(120)) - spam
    assert all(found["page", i] == {1, 2, 3, 4, 5} for i in set(range(120)) - spam)
    assert {i for f, i in found if f == "html"} == {i for i in range(120) if i % 2} - spam
    assert all(v == {6, 7, 8, 9, 10} for (f, _), v in found.items() if f == "html")
    read = pages.read_pages(crawl, raw, docs)
    assert {r.crawl_id for r in read.pages.where("spam").collect()} == spam
    assert read.pages.count() == 121


@pytest.mark.parametrize("max_names", [0, 40])
def test_names_beyond_the_bound_keep_their_weights(spark, monkeypatch, max_names):
    crawl, raw, docs = corpus(spark)
    # a page that comes twice under one id, and one under two hosts
    crawl = crawl.unionByName(crawl.where("crawl_id in (5, 6)")).unionByName(crawl.where("crawl_id = 8").withColumn("host", F.lit("www.site3.example")))

    def results():
        lines = rows(pages.main_lines(crawl, raw, docs))
        return lines, rows(pages.read_pages(crawl, raw, docs, text=True).pages)

    whole = results()
    bounded, made = styletree.line_model, []

    def line_model(labelled):
        made.append((bounded(labelled), bounded(labelled, max_names)))
        return made[-1][1]

    monkeypatch.setattr(styletree, "line_model", line_model)
    assert results() == whole
    full, part = made[0]
    assert len(part.keys) <= max_names and len(part.keys) + part.rest.count() == len(full.keys) and full.rest is None
    # the scores of single lines are the same to the last bit, a name that a line has twice included
    texts = ["Home | News | Contact\n\nThe old castle near the old castle near the old castle", "", "Terms of use\nbuy zorbi xanbu"]
    hosts = ["www.site1.example", None, "www.site2.example"]
    df = spark.createDataFrame([(i, x, h) for i, (x, h) in enumerate(zip(texts, hosts))], "i int, text string, host string")
    found = {r.i: r.rare for r in styletree.with_rare(df, ["i"], "text", str, part).collect()}
    rare = pa.array([found[i] and [x.asDict() for x in found[i]] for i in range(3)])
    lines = linecodes.Lines(texts)
    assert (part.scores(lines, hosts, rare) == full.scores(lines, hosts)).all()
    assert (part.scores(lines, hosts) != full.scores(lines, hosts)).any()


def test_pages_without_html_or_rows(spark):
    crawl, raw, docs = corpus(spark)
    assert pages.read_pages(crawl, raw.where("false"), docs).pages.where("size(main) > 0").count() >= 120
    assert pages.main_lines(crawl.where("false"), raw.where("false"), docs.where("false")).count() == 0


def test_line_model_counts_all_names_and_bounds_their_number(spark):
    rows = [(["Menu", "The old castle of the town"], [styletree.FURNITURE, styletree.BODY], "h.example")] * 40 + [(["Menu"], [styletree.OPEN], None), ([], [], None)]
    rows += [(["Castle tours", "The old castle of the town"], [styletree.BODY, styletree.FURNITURE], "g.example")] * 3
    labelled = spark.createDataFrame(rows, "texts array<string>, label array<int>, host string")
    model = styletree.line_model(labelled)
    scores = model.scores(linecodes.Lines(["Menu\nThe old castle of the town"]))
    assert scores[0].argmax() == styletree.FURNITURE and scores[1].argmax() == styletree.BODY
    assert len(styletree.line_model(labelled, max_names=10).keys) <= 10 < len(model.keys)
    assert model.kinds(scores.tolist())[1] == styletree.BODY
    # a content node that the page's own host always removes is furniture, whatever the words say
    lines = linecodes.Lines(["The old castle of the town", "The old castle of the town", "The old castle of the town"])
    hosts = ["h.example", "g.example", "other.example"]
    assert model.scores(lines, hosts).argmax(axis=1).tolist() == [styletree.BODY, styletree.FURNITURE, styletree.BODY]
    assert model.known(lines, hosts).tolist() == [False, True, False]


def test_prose_model_tells_sentences_from_keywords(spark):
    _, _, docs = corpus(spark)
    model = prose.train(docs, "text", "lang")
    good = "The old bridge near the castle was rebuilt in 1850 after the garden had been closed by the library."
    bad = "cheap xanbu sale xanbu order zorbi cheap zorbi online xanbu sale"
    shares, sizes = model.shares([good, bad, ""])
    assert shares.tolist() == [1.0, 0.0, 1.0] and sizes.tolist() == [18, 11, 0]
    assert prose.language("en-GB") == prose.language("EN") == "en" and prose.language(None) == ""


def test_second_step_learns_the_lists_of_honest_pages(spark):
    _, _, docs = corpus(spark)
    model = prose.train(docs, "text", "lang")
    sentence = "The old {} near the castle was rebuilt in 1850 after the garden had been closed by the library."
    score = "Town 6 - Other 9 ( 865 , wooden table )"
    bodies = ["\n".join([sentence.format(w)] * 3 + [score] * (i % 9)) for i, w in enumerate(["bridge", "museum", "harbour", "meadow"] * 50)]
    bodies += ["\n".join(["cheap xanbu sale xanbu order zorbi cheap zorbi online xanbu sale"] * 5)] * 10

    def encoded(text):
        lines = linecodes.Lines([text])
        line, codes = linecodes.sequences(*lines.tokens(model.vocabulary), np.ones(lines.n_lines, bool))
        share, size = model.prose(line, codes, lines.page, 1)
        return bytes(codes.tobytes()), float(share[0]), int(size[0])

    df = spark.createDataFrame([encoded(x) for x in bodies], "codes binary, prose_share double, n_tokens long")
    second = prose.second_step(model, df)
    owner, codes = prose.joined(pa.array([r.codes for r in df.collect()], pa.binary()))
    odd = second.abnormal(second.means(owner, codes, len(bodies)))
    assert odd[200:].all() and not odd[:200].any()
    assert prose.second_step(model, df.where("false")).pages == (prose.FAR * model.band[0], model.band[1])


def test_second_step_holds_the_arrays_of_few_pages_at_a_time(spark):
    _, _, docs = corpus(spark)
    model = prose.train(docs, "text", "lang")
    rng = np.random.default_rng(1)
    body = np.full((8000, 303), prose.START, np.uint16)
    body[:, 2:-1], body[:, -1] = rng.integers(0, prose.START, (8000, 300)), prose.END
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in body], pa.binary())], names=["codes"])
    peaks = []

    class Pages:
        """One batch of pages whose functions run here, so that their memory can be told."""

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, schema):  # noqa: N802
            tracemalloc.start()
            out = list(run(iter([batch])))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return spark.createDataFrame(pa.Table.from_batches(out))

    second = prose.second_step(model, Pages())
    assert len(peaks) == 2 and max(peaks) < 100e6  # an array of 64-bit numbers for all codes takes 19 MB
    assert second.tables[0].sum() - model.tables[0].sum() == 8000 * 302
    assert second.tables[0, prose.START] - model.tables[0, prose.START] == 8000
    longer = pa.RecordBatch.from_arrays([pa.array([b"ab", None, bytes(prose.CODE_BYTES + 2), b"", b"cd"], pa.binary())], names=["codes"])
    assert [x.column("codes").to_pylist() for x in prose.few(iter([longer]))] == [[b"ab", None], [bytes(prose.CODE_BYTES + 2)], [b"", b"cd"]]


@pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_RANKS), reason="no tokenizer file")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "one two three", 9), (2, "", 9), (3, None, 9), (4, "<|endoftext|> é漢", 9)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in tokens.token_sizes(df, ["id"], "text").collect()}
    encode = tokens.encoding(tokens.DEFAULT_RANKS)
    assert got == {1: 3, 2: 0, 4: len(encode.encode_ordinary("<|endoftext|> é漢"))}
    assert encode.decode(encode.encode_ordinary("é漢 x")) == "é漢 x"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_run_and_equal_their_sql(spark):
    import glob

    duckdb = pytest.importorskip("duckdb")
    from webrank.llm import catalogue

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, query in catalogue.queries().items():
        df = query(spark, SF)
        if name in catalogue.oracle_sql():
            want = con.execute(catalogue.oracle_sql()[name]).fetchall()
            columns = [c[0] for c in con.description]
            assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want)), name
        elif name.endswith("_found"):
            assert df.count() == df.distinct().count() > 0, name
