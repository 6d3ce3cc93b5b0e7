"""Text, table and sheet operators on hand-made rows, with CJK text that the driver tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions import text as T
from lectern.operators import chunking, curate, tables
from lectern.sources import blocks as B
from lectern.sources import sheets


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1).alias("x")])
    return df.select(expr.alias("out")).first().out


def test_tokens_mix_words_and_bigrams(spark):
    assert one(spark, T.tokens(F.col("t")), t="The A cat_1 反应器 温 Éa") == ["the", "cat_1", "éa", "反应", "应器"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


@pytest.mark.parametrize("text,want", [("温度 is 3", "zh"), ("temperature 温 of", "en"), ("!!", "en"), ("", "en"), ("反应器", "zh")])
def test_language(spark, text, want):
    assert one(spark, T.detect_language(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("一共多少家", True), ("列出所有设备", True), ("统计一下设备的数量", True), ("温度是多少", False), ("有几个阀门", True)])
def test_aggregation_questions(spark, text, want):
    assert one(spark, T.is_aggregation_query(F.col("t")), t=text) is want


def test_topics_first_match_wins(spark):
    assert one(spark, T.topic(F.col("t")), t="设备温度") == "工艺参数"
    assert one(spark, T.topic(F.col("t")), t="阀门") == "设备操作"
    assert one(spark, T.topic(F.col("t"), T.TOPICS_PAGES), t="泵") == "设备操作"
    assert one(spark, T.topic(F.col("t")), t="none") == "其他"


def test_clean_values(spark):
    rows = spark.createDataFrame([(v,) for v in (" a ", "", "nan", '[""]', "['']", "[]", '""', None, "x\n")], "v string")
    assert [r.out for r in rows.select(T.clean_value(F.col("v")).alias("out")).collect()] == ["a", None, None, None, None, None, None, None, "x"]


def test_latex(spark):
    assert one(spark, T.clean_latex(F.col("t")), t=r" a $x^2$  b \mathrm{kg}  \times c ") == "a b kg c"


def test_headings(spark):
    text = "7 HSE\n\n7.1 安全\n\n7.1.1 基本概念\n\n7 lower\n\nplain\n\n12 (note)\n\n7.1 two\nlines"
    want = "## 7 HSE\n\n### 7.1 安全\n\n#### 7.1.1 基本概念\n\n7 lower\n\nplain\n\n## 12 (note)\n\n7.1 two\nlines"
    assert one(spark, T.mark_headings(F.col("t")), t=text) == want
    long = "7 " + "A" * 70
    assert one(spark, T.mark_headings(F.col("t")), t=long) == long


def test_paragraphs(spark):
    def pieces(t, size=10):
        return one(spark, T.paragraph_pieces(F.col("t"), size), t=t)

    assert pieces("short") == ["short"] and pieces("") == []
    assert pieces("aaaa\nbbbb\ncc\n" + "d" * 23) == ["aaaa\nbbbb", "cc", "d" * 10, "d" * 10, "ddd"]


def test_windows_give_the_text_back(spark):
    for text in ("one two  three\nfour 五六 seven", "a " * 50, "  leading 反应器温度压力 " * 9, "x"):
        for unit, size, overlap in (("words", 5, 2), ("chars", 7, 3)):
            parts = one(spark, chunking.windows_of(F.col("t"), size, overlap, unit), t=text)
            if unit == "chars":
                back = parts[0] + "".join(p[overlap:] for p in parts[1:])
                assert back == text and all(len(p) <= size for p in parts)
            else:
                units = one(spark, T.units(F.col("t")), t=text)
                back = parts[0] + "".join("".join(one(spark, T.units(F.col("t")), t=p)[overlap:]) for p in parts[1:])
                assert back == "".join(units) == text.lstrip(" ")


def test_sections_and_chunks(spark):
    text = "intro\n# A\nx\n## B\ny\n### C\nz\n## D\nw\n# E"
    rows = spark.createDataFrame([("s", 0, text), ("t", 0, "no heading")], "source string, block long, text string")
    got = chunking.split_sections(rows, ["source"], "block").orderBy("source", "section").collect()
    assert [(r.h1, r.h2, r.h3, r.text) for r in got] == [
        (None, None, None, "intro"), ("A", None, None, "# A\nx"), ("A", "B", None, "## B\ny"), ("A", "B", "C", "### C\nz"),
        ("A", "D", None, "## D\nw"), ("E", None, None, "# E"), (None, None, None, "no heading"),
    ]
    merged = chunking.merge_short_sections(chunking.split_sections(rows, ["source"], "block"), ["source"], "section", min_length=10)
    assert [r.text for r in merged.where("source = 's'").orderBy("section").collect()] == ["intro\n# A\nx", "## B\ny\n### C\nz", "## D\nw\n# E"]


def test_greedy_chunks(spark):
    rows = [("s", 0, None, None, "aaaa"), ("s", 1, None, "k", "bbbb"), ("s", 2, None, "k", "cccc"), ("s", 3, "H", None, "dd"), ("s", 4, "H", "k", "e" * 25)]
    df = spark.createDataFrame(rows, "source string, section long, h2 string, h3 string, text string")
    df = df.withColumn("h1", F.lit(None).cast("string")).withColumn("h4", F.lit(None).cast("string"))
    got = chunking.greedy_chunks(df, ["source"], "section", chunk_size=10, overlap=2).orderBy("section", "piece").collect()
    assert [r.text for r in got] == ["aaaa\nbbbb", "cccc", "dd", "e" * 10, "e" * 10, "e" * 9]


def test_page_segments(spark):
    rows = [("d", 0, 1, "text", "a" * 100), ("d", 1, 2, "text", "b" * 60), ("d", 2, 3, "image", "zz"), ("d", 3, 3, "table", "c" * 40)]
    df = spark.createDataFrame(rows, "doc string, i long, page int, type string, text string")
    got = chunking.page_segments(df, ["doc"], "page", "i").collect()
    assert [(r.page, r.text) for r in got] == [(2, "a" * 100 + "\n" + "b" * 60)]  # the last 40 characters are too few


def test_excerpt_budget(spark):
    rows = [("d", 0, "text", "a" * 5), ("d", 1, "image", "zz"), ("d", 2, "table", "t"), ("d", 3, "text", "b" * 9), ("d", 4, "text", "never")]
    df = spark.createDataFrame(rows, "doc string, i long, type string, text string")
    got = chunking.excerpt_budget(df, ["doc"], ["i"], F.floor(F.col("i") / 2), budget=20).first()
    assert got.text == "aaaaa\n\n[表格]\nt\n[/表格]\n\n" + "b" * 9


HEAD = "| a | b | c |\n|---|---|---|\n"


def merge(spark, *texts, pages=None):
    rows = [("d", i, (pages or [0] * len(texts))[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc string, i long, page int, text string")
    return [r.text for r in tables.merge_tables(df, ["doc"], "i", "page").orderBy("i").collect()]


def test_merge_tables(spark):
    first = "T1\n" + HEAD + "| 1 | x | y |"
    # No caption: rows go below the table before.
    assert merge(spark, first, "| 2 | x | y |") == [first + "\n| 2 | x | y |"]
    # Too far apart.
    assert merge(spark, first, "| 2 | x | y |", pages=[0, 2]) == [first, "| 2 | x | y |"]
    # No data yet: the next block belongs here, its caption names the table behind it.
    assert merge(spark, "T1\n" + HEAD, "T2\n" + HEAD + "| p | q | r |", HEAD + "| z | z | z |") == [
        "T1\n" + HEAD.strip() + "\n| a | b | c |\n| p | q | r |", "T2\n" + HEAD + "| z | z | z |",
    ]
    # Numbers in sequence.
    assert len(merge(spark, first, "T2\n| h | h | h |\n|---|---|---|\n| 2 | x | y |")) == 1
    assert len(merge(spark, first, "T2\n| h | h | h |\n|---|---|---|\n| 3 | x | y |")) == 2
    # A heading row of values, even with other columns; its caption stays at the end of the document.
    assert merge(spark, "| n | v | w |\n|---|---|---|\n| a | x | y |", "T9\n| 1 | 2 | 3 | 4 | 5 |\n|---|---|---|---|---|") == [
        "T9\n| n | v | w |\n|---|---|---|\n| a | x | y |\n| 1 | 2 | 3 | 4 | 5 |"
    ]


def test_html_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr>\n<tr></tr><tr><td> <b>1</b></td><td>2\n</td></tr></table>"
    assert one(spark, M.html_to_markdown(F.col("h")), h=html) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, M.html_has_more_rows(F.col("h"), F.lit("| a | b |")), h=html) is True
    assert one(spark, M.html_has_more_rows(F.col("h"), F.lit("| a |\n|---|\n| 1 |")), h=html) is False


@pytest.mark.parametrize(
    "text,want",
    [
        ("| h |\n|---|---|\n| 1 | a |\n| 2 | b |\n| head | c |", "| h |"),
        ("| h | x |\n| 1 | a |\n| 2 | b |\n| head | c |", "| h | x |\n| 1 | a |\n| 2 | b |"),
        ("| 1 | a |\n| 2 | a | b | c | d |", "| 1 | a |"),
        ("| 1 | a |\n\n| 2 | b |", "| 1 | a |"),
        (" none ", "none"),
    ],
)
def test_truncate(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = M.truncate_table(df, "t").first().t
    assert got == (want if not text.startswith("| h |\n") else "| h |\n| 1 | a |\n| 2 | b |")


def test_empty_tables_look_back(spark):
    rows = [(0, "table", "x", 0, ["first"])] + [(i, "text", "t", 0, []) for i in range(1, 30)]
    rows[12] = (12, "table", "x", 1, ["near"])
    rows[5], rows[20], rows[21], rows[22] = (5, "table", " ", 0, []), (20, "table", "", 2, []), (21, "table", "", 1, []), (22, "table", "", 1, [])
    rows[23] = (23, "table", "", 9, ["own", "name"])
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, i long, type string, text string, page int, table_caption array<string>")
    df = df.withColumn("table_body", F.lit(None).cast("string"))
    got = {r.i: r.context for r in tables.empty_tables(df, ["doc"], "i", "page").collect()}
    # The document's first block is out of reach from near it; 22 is ten blocks behind 12.
    assert got == {5: "", 20: "near", 21: "near", 22: "", 23: "own name"}


def test_scan_blocks(spark, tmp_path):
    (tmp_path / "a_content_list.json").write_text(
        '[{"type":"text","text":" hi ","page_idx":3},{"type":"image","img_path":"x"},'
        '{"type":"table","text":"| a |","table_caption":["T","1"],"table_body":"<tr><td>a</td></tr><tr><td>b</td></tr><tr><td>c</td></tr>"},'
        '{"type":"equation","text":"  "}]', encoding="utf-8",
    )
    (tmp_path / "broken.json").write_text("{", encoding="utf-8")
    got = B.scan_blocks(B.read_blocks(spark, str(tmp_path))).orderBy("block_idx").collect()
    assert [(r.source, r.page, r.block_type, r.text) for r in got] == [
        ("a", 3, "text", "hi"), ("a", None, "table", "T 1\n| a |\n| --- |\n| b |\n| c |"),
    ]
    assert [r.path.rsplit("/", 1)[1] for r in B.broken_files(spark, str(tmp_path)).collect()] == ["broken.json"]


def test_manifest(spark, tmp_path):
    for name, size in (("x/a.pdf", 3), ("x/b.PDF", 3), ("x/empty.pdf", 0), ("x/big.pdf", 50), ("out/c.pdf", 3), ("x/d.txt", 3)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * size)
    got = B.file_manifest(spark, str(tmp_path), skip_folder="out", max_bytes=20)
    assert sorted(r.name for r in got.collect()) == ["a.pdf", "b.PDF"]


def test_sheets(spark):
    rows = spark.createDataFrame([(1, "n", " ", "13800"), (2, "", "", "")], "id int, name string, note string, `手机号` string")
    got = sheets.rows_to_documents(rows, ["name", "note"], ["id"]).collect()
    assert [(r.meta_id, r.text) for r in got] == [("1", "name：n")]
    header = sheets.entity_header("项目", F.col("name"), [F.col("note")], " — ")
    got = sheets.entity_header_chunk(rows, header, ["name", "note", "手机号"], ["id"]).collect()
    assert [r.text for r in got] == ["【项目】n\nname：n"]  # contact columns never become text


def item(**changes):
    base = dict(question="What is the temperature?", ground_truth="It is 400 degrees", source_text="text: It is 400 degrees there", question_type="factual", difficulty="single_hop", page=1)
    return {**base, **changes}


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, []),
        ({"difficulty": ""}, ["missing:difficulty"]),
        ({"page": 0}, []),
        ({"page": None}, ["missing:page"]),
        ({"question_type": "open"}, ["invalid:question_type"]),
        ({"question": r"What is $x$ here?"}, ["latex:question"]),
        ({"source_text": "list of contents ...... 12"}, ["artifact:source_text", "overlap:none"]),
        ({"ground_truth": "1"}, ["short:ground_truth"]),
        ({"question_type": "negative", "ground_truth": "否"}, []),
        ({"question_type": "negative", "ground_truth": "maybe"}, ["form:negative"]),
        ({"question": "q" * 201}, ["long:question"]),
        ({"question": "short"}, ["short:question"]),
        ({"ground_truth": "nothing alike!!"}, ["overlap:none"]),
        ({"ground_truth": "nothing alike!!", "question_type": "reasoning"}, []),
    ],
)
def test_qa_checks(spark, changes, want):
    schema = "question string, ground_truth string, source_text string, question_type string, difficulty string, page int"
    row = item(**changes)
    df = spark.createDataFrame([tuple(row[f.split(" ")[0]] for f in schema.split(", "))], schema)
    assert curate.qa_checks(df).first().issues == want


@pytest.mark.parametrize(
    "raw,n",
    [
        ('[{"question":"a","ground_truth":"b","source_text":"c","question_type":"d"}]', 1),
        ('```json\n{"items":[{"question":"a","ground_truth":"b","source_text":"c","question_type":"d"}]}\n```', 1),
        ('Sure: [{"question":"a \\sqrt b","ground_truth":"b","source_text":"c","question_type":"d"}] done', 1),
        ('[{"question":"a","ground_truth":"b","source_text":"c"}]', 0),
        ("no list", 0),
        ("[broken", 0),
    ],
)
def test_replies(spark, raw, n):
    df = spark.createDataFrame([(7, raw)], "id int, raw string")
    got = curate.parse_qa_replies(df, ["id"]).collect()
    assert len(got) == n and all(r.id == 7 for r in got)


def test_allocation_stops_at_target(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((100, 400, 2000, 4000, 9000, 500))], "id long, text string")
    got = curate.allocate_questions(docs, "id", F.floor(F.col("id") / 2), 30, F.length("text"), done=2).orderBy("id").collect()
    assert [(r.id, r.n_questions) for r in got] == [(1, 5), (2, 8), (3, 12), (4, 3), (5, 0)]
    split = spark.range(1).select(*[c.alias(n) for n, c in curate.type_split(F.lit(5), curate.SHARES_PAGES).items()]).first()
    assert (split.factual, split.reasoning, split.negative) == (2, 2, 1)  # 2.5 and 1.5 round to even


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("g"))
    a = sorted(r.id for r in curate.stratified_sample(df, "id", 7, "g").collect())
    assert len(a) == 21 and a == sorted(r.id for r in curate.stratified_sample(df.repartition(5), "id", 7, "g").collect())
    assert curate.stratified_sample(df, "id", 9).count() == 9


def test_packed_block_lists_equal_one_file_each(spark, tmp_path):
    """Lists that lie many to a file, one a line, give the rows of lists in files of their own; a broken line gives none."""
    lists = {"a": [{"type": "text", "text": "one\ntwo\r three"}, {"type": "image", "text": "x"}, {"type": "equation", "text": " y "}], "b é": [], "c": [{"type": "text", "text": "z", "page_idx": 4}]}
    for k, (doc, own) in enumerate(lists.items()):
        (tmp_path / "each").mkdir(exist_ok=True)
        (tmp_path / "each" / f"{doc}_content_list.json").write_text(json.dumps(own))
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "part-0.txt").write_text("\n".join([*(json.dumps({"doc": d, "blocks": own}) for d, own in lists.items()), "{broken"]))
    each, packed = (sorted(map(tuple, B.scan_blocks(B.read_blocks(spark, str(tmp_path / name), packed=name == "packed")).collect())) for name in ("each", "packed"))
    assert each == packed and len(each) == 3


def test_scan_blocks_writes_few_files(spark, monkeypatch):
    """The number of files does not grow with that of the documents (30 in this table)."""
    import glob

    import __spark_entry__ as entry
    from lectern.plans import shaping

    paths = []
    monkeypatch.setattr(shaping, "work_path", lambda s, name, real=shaping.work_path: paths.append(real(s, name)) or paths[-1])
    found = entry.queries()["scan_blocks"](spark, "/root/testdata/sf0.001")
    assert found.select("source").distinct().count() == 30
    assert 0 < len(glob.glob(f"{paths[0].removeprefix('file:')}/**/*.txt", recursive=True)) <= 8
