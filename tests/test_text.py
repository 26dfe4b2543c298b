import time

import pytest
from pyspark.sql import functions as F

from loamwork.functions import jsonio
from loamwork.functions import text as T
from loamwork.operators.chunk import chunk_paragraphs, explode_chunks, join_chunks


def value(spark, function, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    return df.select(function(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("CHINA SOUTHERN POWER GRID CO., LTD.\nBody", "Body"),
        ("$\\textcircled{1}$ first\nsee $\\textcircled{2}$", "1. first\nsee (2)"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n  12  \nb", "a\nb"),
        ("line  \nnext", "line\nnext"),
        ("　 plain　", "plain"),
        ("", ""),
    ],
)
def test_regex_clean(spark, text, want):
    assert value(spark, T.regex_clean, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("$45^{\\circ}$", "45°"), ("$\\geqslant$", "≥"), ("$\\leq 0.5$", "≤0.5"), ("$x^2$", "$x^2$"), ("$\\notin$ $\\in$", "∉ ∈"), ("no math", "no math")],
)
def test_latex(spark, text, want):
    assert value(spark, T.latex_to_unicode, text) == want


def test_table_separators(spark):
    assert value(spark, T.fix_table_separators, "-" * 100) == "---"
    assert value(spark, T.fix_table_separators, "|---|---|") == "|---|---|"
    assert value(spark, T.fix_table_separators, "|" + "-" * 300 + "|" + "-" * 300 + "|\nx") == "|---|---|\nx"
    assert value(spark, T.fix_table_separators, "|" + "-" * 150 + "|" + "-" * 100) == "|---|---|"


def test_html(spark):
    html = "before<table><tr><th>A</th><th>B</th></tr><tr><td>1<br>2</td></tr></table>after<hr/>x<sup>2</sup><br/>y"
    assert value(spark, T.clean_html, html) == "before| A | B |\n| --- | --- |\n| 1 2 |  |after\n---\nx2\ny"
    assert value(spark, T.clean_html, "plain") == "plain"


@pytest.mark.parametrize(
    ("text", "want"),
    [("好的，正文", "正文"), ("Here is the text:\nBody", "Body"), ("```markdown\nBody\n```", "Body"), ("Body\n以上是全部内容", "Body"), ("", "")],
)
def test_post_process(spark, text, want):
    assert value(spark, T.post_process, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Here is the text:\nSurely not", "Surely not"), ("Here is the text:\nThe following: x", "The following: x"), ("好的，以下是正文：\n为您: x", "为您: x"), ("Sure, I have it:\nBody", "Body")],
)
def test_an_announced_text_stays(spark, text, want):
    assert value(spark, T.post_process, text) == want


def test_only_the_first_heading_is_replaced(spark):
    assert value(spark, lambda c: T.normalize_chapter_title(c, 6), "第六章 做法\nsrc\n6. Step\n6、x") == "六、施工方法及工艺要求\nsrc\n6. Step\n6、x"
    assert value(spark, lambda c: T.normalize_chapter_title(c, 6), "a 6. b\n6. X\n第六章 Y") == "a 6. b\n六、施工方法及工艺要求\n第六章 Y"


def test_table_of_many_rows(spark):
    rows = 4000
    html = "a<table>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>\n" for i in range(rows)) + "</table>b"
    began = time.monotonic()
    got = value(spark, T.clean_html, html)
    assert got.split("\n") == ["a| 0 | x |", "| --- | --- |", *(f"| {i} | x |" for i in range(1, rows - 1)), f"| {rows - 1} | x |b"]
    assert time.monotonic() - began < 10


@pytest.mark.parametrize(
    ("original", "cleaned", "want"),
    [
        ("abcd", "ab", (True, True, True)), ("abcd", "a", (False, True, True)), ("", "", (True, True, True)), ("x", "ok\n好的，y", (True, False, True)),
        ("x", "he said 好的", (True, True, True)), ("x", "a | b", (True, True, False)), ("x", "| a |\n|---|", (True, True, True)),
    ],
)
def test_verify(spark, original, cleaned, want):
    assert tuple(value(spark, T.verify, original, cleaned)) == want


def test_titles(spark):
    assert value(spark, T.sub_section_id, "7.3 Title") == "7.3"
    assert value(spark, T.sub_section_id, "六、施工") == "6"
    assert value(spark, T.sub_section_id, "none") == ""
    assert value(spark, T.clean_title, "第一章 编制依据") == "编制依据"
    assert value(spark, T.clean_title, "(2) 概况") == "概况"
    assert value(spark, lambda c: T.normalize_chapter_title(c, 6), "第六章做法\n第六章再") == "六、施工方法及工艺要求\n第六章再"
    assert value(spark, lambda c: T.fill_project_name(c, F.lit(r"a\1$2")), "【工程名称】") == r"a\1$2"
    assert value(spark, T.normalize_chapter_name, "安全管理措施（试行）") == "安全管理措施"


def test_bigrams_and_jaccard(spark):
    both = lambda a, b: T.jaccard(T.bigrams(a), T.bigrams(b))
    assert value(spark, both, "", "") == 1.0
    assert value(spark, both, "ab", "") == 0.0
    assert value(spark, both, "abc", "abd") == pytest.approx(1 / 3)


def test_document_content(spark):
    df = spark.createDataFrame([("变电", "s", ["a", "b"], "body"), (None, "", None, "body")], "k string, s string, t array<string>, c string")
    got = [r[0] for r in df.select(T.document_content(F.col("k"), F.col("s"), F.col("t"), F.col("c"))).collect()]
    assert got == ["[工程类型: 变电] [章节: s] [标签: a, b]\nbody", "body"]


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [("", 10, [""]), ("aaaa\n\nbbbb\n\ncc", 9, ["aaaa", "bbbb\n\ncc"]), ("a\n\nb", 10, ["a\n\nb"]), ("aaaaaa\n\n# h", 10, ["aaaaaa", "# h"])],
)
def test_chunks(spark, text, size, want):
    assert value(spark, lambda c: chunk_paragraphs(c, size), text) == want


def test_chunks_rejoin(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\nc"), (2, "")], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in join_chunks(explode_chunks(docs, 2)).collect()} == {1: "a\n\nb\n\nc", 2: ""}


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 2}\n```', '{"a": 2}'), ('say {"a": 3} end', '{"a": 3}'), ("nothing", None), ("{bad", None), ("", None)],
)
def test_extract_json(spark, text, want):
    assert value(spark, jsonio.extract_json, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"density": "low", "reason": "r"}', "low"), ('```json\n{"density": "high"}\n```', "high"), ('{"density": "odd"}', "medium"), ("it is high", "high"), ("?", "medium")],
)
def test_grades(spark, text, want):
    assert value(spark, jsonio.grade_of, text)["density"] == want


def test_graph_reply(spark):
    reply = '{"entities": [{"type": "process", "name": "a"}, {"type": "odd", "name": "b"}, {"type": "hazard", "name": " "}], "relations": [{"type": "produces_hazard", "source": "a", "target": "c", "evidence": "e"}, {"type": "x", "source": "a", "target": "c"}]}'
    got = value(spark, jsonio.graph_of, reply)
    assert [e["name"] for e in got["entities"]] == ["a"]
    assert [r["target"] for r in got["relations"]] == ["c"]
    assert value(spark, jsonio.graph_of, "junk")["entities"] == []
