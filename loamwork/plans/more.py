"""Further queries: scalar functions, reports as tables, models' stand-ins, whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import jsonio, vectors
from loamwork.functions import text as T
from loamwork.operators import annotate, chunk, dedup, entities, evaluate, graph, index, retrieve, sections, tables
from loamwork.operators.ranks import number
from loamwork.plans import external, flows, queries, rules
from loamwork.plans.queries import query, table
from loamwork.sources import readers
from loamwork.storage import stage, table_path

# ---- scalar functions


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3.' || doc_id WHEN 1 THEN ['1', '2', '3', '4', '5', '6', '7', '8', '9', '10'][doc_id % 10 + 1] ELSE '' END AS sub_id FROM documents""")
def sub_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with dotted numbers, Chinese numerals, and neither."""
    doc = F.col("doc_id")
    numeral = F.element_at(F.array(*map(F.lit, rules.CHINESE_DIGITS)), (doc % 10 + 1).cast("int"))
    title = F.when(doc % 4 == 0, F.concat(F.lit("3."), doc.cast("string"), F.lit(" "), "text")).when(doc % 4 == 1, F.concat(numeral, F.lit("、"), "text")).when(doc % 4 == 2, F.concat(F.lit("第3 "), "text")).otherwise(F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sub_section_id(title).alias("sub_id"))


@query("""SELECT doc_id, doc_id % 4 IN (0, 1) AS has_table FROM documents""")
def table_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.translate("text", "|<", "  ")
    body = F.when(doc % 4 == 0, F.concat(text, F.lit("\n<TABLE>"))).when(doc % 4 == 1, F.concat(F.lit("| a\n"), text, F.lit("\n  | b"))).when(doc % 4 == 2, F.concat(text, F.lit("\n| a"))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", T.has_table(body).alias("has_table"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(role || ' ' || text, ' ')) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM w""")
def jaccard_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.split(c, " ", -1))
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.round(T.jaccard(words(F.col("text")), words(F.concat("role", F.lit(" "), "text"))), 6).alias("similarity"))


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN '' ELSE '[工程类型: ' || source || '] ' END || CASE WHEN doc_id % 2 = 0 THEN '[章节: ' || lang || '] ' ELSE '' END || '[标签: a, b, c, d, e, f, g, h]' || chr(10) || text) AS digest FROM documents""")
def document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.lit(None))
    section = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    tags = F.array(*map(F.lit, "abcdefghij"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.document_content(kind, section, tags, F.col("text"))).alias("digest"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[施工设备]' ELSE '[other]' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '; 工程类型: ' || p_brand END || '; 属性: size=' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '; 别名: ' || p_type || ', a, b, c, d' END
  || '; 来源: rule, 置信度: 0.8' AS description FROM part""")
def entity_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind, engineering = F.when(k % 2 == 0, "equipment").otherwise("other"), F.when(k % 3 == 0, rules.COMMON_TYPE).otherwise(F.col("p_brand"))
    aliases = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_type"), *map(F.lit, "abcde")))
    described = T.entity_description(kind, engineering, F.create_map(F.lit("size"), F.col("p_size").cast("string")), aliases, F.lit(None).cast("string"), F.lit(0.8))
    return table(spark, sf_dir, "part").select("p_partkey", described.alias("description"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || '质量' ELSE c_mktsegment || '管理x' END AS name FROM customer""")
def chapter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.concat("c_mktsegment", F.when(k == 0, F.lit("（一）措施")).when(k == 1, F.lit("质量(a) (b)管理")).otherwise(F.lit("管理x（方案）")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_chapter_name(name).alias("name"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS elapsed FROM (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS s FROM events)""")
def elapsed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.elapsed(F.floor(F.abs("value") * 100)).alias("elapsed"))


@query("""SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13) || '"''“”')) AS digest FROM conversations""")
def quote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit(" “\"'"), T.strip(F.col("text")), F.lit("'\"”\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_quotes(quoted)).alias("digest"))


@query(f"""SELECT item_id, md5('<Instruct>: {rules.RERANK_INSTRUCTION}' || chr(10) || '<Query>: ' || text || chr(10) || '<Document>: ' || item_id) AS digest FROM benchmark""")
def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.rerank_pair(F.col("text"), F.col("item_id").cast("string"))).alias("digest"))


@query("SELECT event_id, round(1 / (1 + exp(5 - value)), 6) AS score FROM events")
def yes_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(vectors.yes_probability(F.lit(5.0), F.col("value")), 6).alias("score"))


@query("SELECT item_id, 32 AS size, 1.0::DOUBLE AS norm, count(*) OVER (PARTITION BY text) AS equals FROM benchmark")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors, one for each different text."""
    made = table(spark, sf_dir, "benchmark").withColumn("e", vectors.hash_embedding(F.col("text"), 32))
    same = made.groupBy(F.col("e").alias("v")).agg(F.count(F.lit(1)).alias("equals"))
    return made.join(same, F.col("e") == F.col("v")).select("item_id", F.size("e").alias("size"), F.round(vectors.norm(F.col("e")), 5).alias("norm"), "equals")


# ---- JSON


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 2 THEN 'no JSON object in: ' || event_type END AS error FROM events""")
def json_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```\nDone."))).when(i == 1, F.concat(F.lit("a "), "props", F.lit(" b"))).otherwise(F.col("event_type"))
    got = jsonio.require_json(reply)
    return table(spark, sf_dir, "events").select("event_id", F.from_json(got["json"], "k BIGINT")["k"].alias("k"), got["error"].alias("error"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'pdf' ELSE 'text' END AS kind FROM pages""")
def input_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    source = F.when(k == 0, F.concat(F.lit(" {"), "html")).when(k == 1, F.concat("url", F.lit(".PDF"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", jsonio.input_kind(source).alias("kind"))


@query("""SELECT s_suppkey, CAST(json_object('name', s_name, 'nation', s_nationkey, 'none', NULL) AS VARCHAR) AS item FROM supplier""")
def item_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("none"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", jsonio.to_json_text(*fields).alias("item"))


# ---- sections and fragments

_SQL_MAPPED = queries._SQL_MAPPED


def _mapped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries._sections(spark, sf_dir).withColumn("chapter_id", queries._mapped()["chapter_id"])


@query(f"WITH {_SQL_MAPPED} SELECT doc_id, count(*) AS sections, count(*) FILTER (chapter_id <> 'unmapped') AS mapped, round(count(*) FILTER (chapter_id <> 'unmapped') / count(*), 6) AS rate FROM mapped GROUP BY doc_id")
def mapped_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.mapped_rate(_mapped_sections(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_SQL_MAPPED} SELECT chapter_id <> 'unmapped' AS mapped, count(*) AS n FROM mapped GROUP BY 1")
def unmapped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with a chapter, and the others."""
    parts = sections.mapped_and_not(_mapped_sections(spark, sf_dir))
    counted = [rows.select(F.lit(flag).alias("mapped")).groupBy("mapped").agg(F.count(F.lit(1)).alias("n")) for rows, flag in zip(parts, (True, False), strict=True)]
    return counted[0].unionByName(counted[1])


@query(f"WITH {_SQL_MAPPED} SELECT chapter_id, doc_id, pos, title FROM mapped WHERE chapter_id IN ('unmapped', 'excluded')")
def title_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.title_lists(_mapped_sections(spark, sf_dir))


@query(f"WITH {_SQL_MAPPED} SELECT chapter_id, count(*) AS n FROM mapped GROUP BY chapter_id")
def coverage_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.coverage_by(_mapped_sections(spark, sf_dir), "chapter_id")


_RULES = (("A", "Overview", ("overview",), ("view",), (), ()), ("B", "Quality", (), ("quality",), (), ()), ("C", "Safety", (), ("safety",), (), ("xThe",)))
_SQL_ANALYSIS = queries._SQL_SECTIONS + """,
tiers AS (SELECT doc_id, pos, title, contains(title, 'notes') AS a, CASE WHEN contains(title, 'overview') THEN 'exact' WHEN contains(title, 'view') OR contains(title, 'quality') OR contains(title, 'safety') THEN 'variant' ELSE 'unmapped' END AS kind,
  CASE WHEN contains(title, 'overview') THEN 'overview' WHEN contains(title, 'view') THEN 'view' WHEN contains(title, 'quality') THEN 'quality' WHEN contains(title, 'safety') THEN 'safety' ELSE '' END AS keyword FROM sections)"""


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mapping = sections.map_title_detailed(F.col("title"), _RULES)
    return sections.analyze_coverage(queries._sections(spark, sf_dir), mapping, F.contains("title", F.lit("notes")))


@query(f"WITH {_SQL_ANALYSIS} SELECT count(*) FILTER (a) AS administrative, count(*) FILTER (NOT a) AS sections, count(*) FILTER (NOT a AND kind = 'exact') AS exact, count(*) FILTER (NOT a AND kind = 'variant') AS variant, count(*) FILTER (NOT a AND kind = 'unmapped') AS unmapped FROM tiers")
def coverage_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)[0]


@query(f"WITH {_SQL_ANALYSIS} SELECT keyword, kind AS match_type, count(*) AS n FROM tiers WHERE NOT a AND keyword <> '' GROUP BY ALL ORDER BY n DESC, keyword LIMIT 15")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir)[1]


@query("""SELECT doc_id, doc_id % 5 = 0 AS ambiguous FROM documents""")
def ambiguous_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare broad words, the same with more, and titles that no rule fits."""
    k = F.col("doc_id") % 5
    title = F.when(k == 0, F.lit("三、概述")).when(k == 1, F.lit("概述与安全措施")).when(k == 2, F.concat(F.lit("施工"), "source")).otherwise(F.col("source"))
    mapping = sections.map_title_detailed(F.col("title"), (("Ch2", "x", (), ("概述",), (), ()),))
    docs = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return docs.select("doc_id", sections.is_ambiguous(F.col("title"), mapping).alias("ambiguous"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(pos % 3 + 1 AS INT) AS level, trim('w' || translate(line, '#图表', '')) AS name FROM l WHERE pos % 5 < 3""")
def chapter_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as numbered headers; those of words that aren't chapters and those too deep are passed over."""

    def line(text, i):
        clean = F.translate(text, "#图表", "")
        mark = F.repeat(F.lit("#"), (i % 3 + 1).cast("int"))
        return F.when(i % 5 < 3, F.concat(mark, F.when(i % 2 == 0, F.lit(" 三、w")).otherwise(F.lit(" 2.1 w")), clean)).when(i % 5 == 3, F.concat(mark, F.lit(" 附件 "), clean)).otherwise(F.concat(F.lit("#### "), clean))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))
    return sections.chapter_headers(docs, rules.NO_CHAPTER_WORDS[:4]).select("doc_id", "pos", "level", "name")


_SQL_NAMED = queries._SQL_SECTIONS + ", named AS (SELECT *, split_part(title, ' ', 1) AS name FROM sections)"


def _first_word():
    return F.substring_index("title", " ", 1)


@query(f"WITH {_SQL_NAMED}, u AS (SELECT name, level, last_value(CASE WHEN level = 1 THEN name END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM named) SELECT chapter, name, count(*) AS n FROM u WHERE level = 2 AND chapter IS NOT NULL GROUP BY ALL")
def second_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.second_level(queries._sections(spark, sf_dir), _first_word())


@query(f"WITH {_SQL_NAMED}, o AS (SELECT name, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM named WHERE level = 1), c AS (SELECT place, name, count(*) AS n FROM o WHERE place <= 3 GROUP BY ALL) SELECT CAST(place AS INT) AS place, name, n FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY n DESC, name) AS r FROM c) WHERE r <= 5")
def opening_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.opening_chapters(queries._sections(spark, sf_dir), name=_first_word())


@query(f"WITH {queries._SQL_SECTIONS}, d AS (SELECT doc_id, count(*) AS headers, count(*) FILTER (level = 1) AS chapters, max(level) AS deepest FROM sections GROUP BY doc_id) SELECT count(*) AS documents, CAST(sum(headers) AS BIGINT) AS headers, CAST(sum(chapters) AS BIGINT) AS chapters, max(deepest) AS max_level, round(avg(headers), 6) AS mean_headers, round(avg(chapters), 6) AS mean_chapters FROM d")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.corpus_summary(queries._sections(spark, sf_dir))
    return out.withColumn("mean_headers", F.round("mean_headers", 6)).withColumn("mean_chapters", F.round("mean_chapters", 6))


def _chinese_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines stand under four Chinese headings."""
    heads = ("# 一、编制依据 编制单位", "## 1.1 法规", "# 目录", "# 第六章 施工方法", "### 二、x")
    parts = [x for h in heads for x in (F.lit(f"{h}\n"), F.translate("text", "#", ""), F.lit("\n"))]
    return table(spark, sf_dir, "documents").where("n_chars > 100").select(F.col("doc_id"), F.concat(F.lit("cover\n"), *parts).alias("text"))


@query("""WITH p(pos, title, chapter_id, sub_section_id) AS (VALUES (0, '一、编制依据 编制单位', 'Ch1', '1'), (1, '1.1 法规', 'Ch1', '1.1'), (3, '第六章 施工方法', 'Ch6', ''), (4, '二、x', 'Ch6', '2'))
SELECT doc_id, pos, title, chapter_id, sub_section_id FROM documents, p WHERE n_chars > 100""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers, no exclusions, administrative titles dropped before inheritance."""
    docs = _chinese_docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[0-9]{4}", ""))
    return sections.split_documents(docs).select("doc_id", "pos", "title", "chapter_id", "sub_section_id")


@query("""SELECT doc_id AS source_doc, CAST(row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) AS BIGINT) AS place FROM documents""")
def fragment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by priority, document and position; the ranks are read off the ordered rows."""
    priority = F.when(F.col("lang") == "en", "P0").when(F.col("lang") == "de", "P1").when(F.col("lang") == "fr", "P2").otherwise("P9")
    ordered = annotate.order_fragments(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_doc"), priority.alias("priority"), F.lit(0).alias("pos")))
    # ordered rows are dealt by ranges, so a row's place is those before its part and its place there
    dealt = stage(ordered.withColumn("_i", F.monotonically_increasing_id()), "ordered")
    return number(dealt, "_i", "place").select("source_doc", "place")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'high' WHEN doc_id % 4 = 1 THEN 'medium' END AS density FROM documents WHERE doc_id % 4 < 2""")
def density_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return dedup.by_density(table(spark, sf_dir, "documents").select("doc_id", grade.alias("density")))[0]


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS INT) AS source_doc, lang AS chapter, n_chars > 500 AS has_table, md5(text) AS digest, 15 AS fields FROM documents""")
def fragment_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("chapter"), (F.col("n_chars") > 500).alias("has_table"), F.col("text").alias("content"), F.lit(1).alias("other"))
    out = readers.project_fragments(docs)
    return out.select("id", "source_doc", "chapter", "has_table", F.md5("content").alias("digest"), F.lit(len(out.columns)).alias("fields"))


@query("""WITH c AS (SELECT source AS value, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source) SELECT * FROM c ORDER BY n DESC, first LIMIT 7""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.most_common(table(spark, sf_dir, "documents"), "source", "doc_id", 7)


@query("""SELECT lang, doc_id, CAST(place AS INT) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 5""")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.first_of_each(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("""WITH s AS (SELECT * FROM documents WHERE doc_id % 50 = 0), have AS (SELECT count(*) AS n FROM s WHERE n_chars > 1024),
more AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS r FROM documents WHERE n_chars > 1024 AND doc_id % 50 <> 0)
SELECT doc_id FROM s UNION ALL SELECT doc_id FROM more, have WHERE r <= greatest(0, 60 - n)""")
def top_up_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return annotate.top_up_long(docs.where("doc_id % 50 = 0"), docs, "n_chars", "doc_id", 1024, 60).select("doc_id")


# ---- rule documents


@query("""SELECT p_partkey AS doc_id, p_name AS name, CASE WHEN p_brand <> '' THEN p_brand END AS scene, '通用' AS engineering_type FROM part""")
def measure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = F.concat(F.lit("## 1. a\n\n### 1.1 "), "p_brand", queries._sheet("", "| 序号 | 措施 |", "p_name"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), sheet.alias("text"))
    return tables.measure_facts(docs).select("doc_id", "name", F.col("attributes")["scene"].alias("scene"), "engineering_type")


@query("""SELECT p_partkey AS doc_id, p_name AS source, p_type AS target, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS whs, CASE p_partkey % 3 WHEN 0 THEN '变电电气' WHEN 1 THEN '变电土建' ELSE '特殊作业' END AS engineering_type, p_name || ' → ' || p_type AS evidence FROM part""")
def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layouts: with W/H/S points, weak points by number, and process with point."""
    whs = F.concat(F.lit("### 4.1 x\n| 工序 | W/H/S 点 | 要点 |\n|---|---|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), "p_type", F.lit(" |\n"))
    weak = queries._sheet("## 2. y", "| 序号 | 薄弱 | 预防 |", "p_name", "p_type")
    plain = F.concat(F.lit("### 6.1 z\n| 工序 | 要点 |\n|---|---|\n| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\n"))
    k = F.col("p_partkey") % 3
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(k == 0, whs).when(k == 1, weak).otherwise(plain).alias("text"))
    found, links = tables.quality_facts(docs)
    points = found.where("type = 'quality_point'").select("doc_id", F.col("attributes")["whs_point"].alias("whs"), "engineering_type")
    return links.select("doc_id", "source", "target", "evidence").join(points, "doc_id")


@query("""SELECT p_partkey AS doc_id, 'process' AS type, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '变电土建' ELSE '通用' END AS engineering_type FROM part UNION ALL SELECT p_partkey, 'process', '钻机就位', CASE WHEN p_partkey % 2 = 0 THEN '变电土建' ELSE '通用' END FROM part
UNION ALL SELECT p_partkey, 'process', p_type, CASE WHEN p_partkey % 2 = 0 THEN '变电土建' ELSE '通用' END FROM part UNION ALL SELECT p_partkey, 'equipment', '钻机', CASE WHEN p_partkey % 2 = 0 THEN '变电土建' ELSE '通用' END FROM part UNION ALL SELECT p_partkey, 'equipment', '混凝土搅拌机', CASE WHEN p_partkey % 2 = 0 THEN '变电土建' ELSE '通用' END FROM part""")
def reference_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, flow charts and tables that name processes and equipment."""
    text = F.concat(F.lit("## 1. "), "p_name", F.lit("\n```\n1. 钻机就位 → 2、"), "p_type", F.lit("\n```\n\n| 项 | 值 |\n|---|---|\n| 混凝土搅拌机 | x |\n## 2. 参数\n"))
    name = F.when(F.col("p_partkey") % 2 == 0, "civil_works.md").otherwise("other.md")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("name"), text.alias("text"))
    return tables.reference_facts(docs)[0].select("doc_id", "type", "name", "engineering_type")


@query("""SELECT doc_id, '2' AS section_id, md5('## 2. a' || chr(10) || source || chr(10)) AS digest FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, '3.1', md5('### 3.1 c' || chr(10) || lang) FROM documents""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with a number; of two with one number the last holds."""
    first = F.when(F.col("doc_id") % 2 == 0, "## 2. a").otherwise("## b")
    text = F.concat(F.lit("### 3.1 old\nx\n"), first, F.lit("\n"), "source", F.lit("\n### 3.1 c\n"), "lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return tables.numbered_sections(docs).select("doc_id", "section_id", F.md5("content").alias("digest"))


# ---- entities, relations, graph


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS source, o_orderstatus AS target FROM orders)
SELECT CASE source WHEN '5-LOW' THEN 'low' ELSE source END AS source, CASE target WHEN 'P' THEN 'pending' ELSE target END AS target, min(o_orderkey) AS first_seq FROM r GROUP BY 1, 2""")
def endpoint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends are renamed by the map of merged names, once, and kept where it has none."""
    rel = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target"), F.lit("r").alias("relation_type"), F.lit(1.0).alias("confidence"), F.lit("e").alias("evidence"))
    names = spark.createDataFrame([("5-LOW", "low"), ("P", "pending"), ("low", "lower")], "old string, name string")
    return entities.dedup_relations(rel, names).select("source", "target", "first_seq")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 AND s_suppkey IS NOT NULL THEN 'id' || l_suppkey WHEN l_partkey % 2 = 0 THEN 'alias' || l_suppkey ELSE 'x' || l_suppkey END AS tgt_id FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def endpoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends by an alias of an entity, or as they are."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("id"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias"), F.col("s_suppkey").cast("string"))).alias("aliases"))
    target = F.concat(F.when(F.col("l_partkey") % 2 == 0, "alias").otherwise("x"), F.col("l_suppkey").cast("string"))
    rel = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("s").alias("source"), target.alias("target"))
    return entities.resolve_endpoints(rel, known).select("l_orderkey", "l_linenumber", "tgt_id")


@query("""SELECT p_partkey AS seq, p_name AS name FROM part WHERE p_type = 'ECONOMY' AND p_brand IN ('Brand#2', '通用') ORDER BY p_partkey LIMIT 1""")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entity with an alias, of a kind of work."""
    return entities.find_entity(queries._part_entities(spark, sf_dir), "ECONOMY", "equipment", "Brand#2").select("seq", "name")


@query("""SELECT 'entity_type' AS kind, 'equipment' AS value, count(*) AS n FROM part UNION ALL SELECT 'engineering_type', p_brand, count(*) FROM part GROUP BY p_brand
UNION ALL SELECT 'relation_type', ['requires_equipment', 'produces_hazard', 'mitigated_by', 'requires_quality_check'][l_linenumber % 4 + 1], count(*) FROM lineitem GROUP BY ALL""")
def kg_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.distributions(queries._part_entities(spark, sf_dir), queries._line_relations(spark, sf_dir))


def _graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries._part_entities(spark, sf_dir).withColumn("id", F.concat(F.lit("p"), F.col("seq").cast("string")))


_SQL_NODES = """n AS (SELECT p_name AS name, max(p_partkey) AS last FROM part GROUP BY p_name),
node AS (SELECT n.name, 'equipment' AS entity_type, '[施工设备]; 工程类型: ' || p_brand || '; 属性: size=' || p_size || '; 别名: ' || p_type || '; 来源: ' || CASE WHEN p_partkey % 2 = 0 THEN 'rule' ELSE 'llm' END || ', 置信度: 0.8' AS description, 'p' || last AS source_id FROM n JOIN part ON p_partkey = last)"""


@query(f"WITH {_SQL_NODES} SELECT * FROM node")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_graph_entities(spark, sf_dir))


@query(f"WITH {_SQL_NODES} SELECT name, entity_type AS type, description FROM node")
def kg_nodes_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = graph.nodes(_graph_entities(spark, sf_dir)).withColumn("name", F.concat(F.lit('"'), "name", F.lit('"')))
    return graph.entities_of_type(quoted, "equipment")


@query(f"WITH {_SQL_NODES} SELECT name, source_id FROM node WHERE name = 'red widget'")
def kg_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_node(graph.nodes(_graph_entities(spark, sf_dir)), "red widget").select("name", "source_id")


@query(f"WITH {queries._SQL_GRAPH} SELECT (SELECT count(DISTINCT p_name) FROM part) AS nodes, (SELECT count(*) FROM best b WHERE EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = b.source) AND EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = replace(b.target, 's', 'p'))) AS edges, (SELECT count(*) FROM best) - (SELECT count(*) FROM best b WHERE EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = b.source) AND EXISTS (SELECT 1 FROM part WHERE 'p' || p_partkey = replace(b.target, 's', 'p'))) AS dangling")
def kg_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole conversion, counted."""
    rel = queries._graph_tables(spark, sf_dir)[1].withColumn("tgt_id", F.regexp_replace("tgt_id", "s", "p"))
    nodes, edges, _, dangling = graph.convert(_graph_entities(spark, sf_dir), rel)
    n = F.count(F.lit(1))
    return nodes.agg(n.alias("nodes")).crossJoin(edges.agg(n.alias("edges"))).crossJoin(dangling.agg(n.alias("dangling")))


@query(f"WITH {queries._SQL_RULES} SELECT name, CAST(ord AS INT) AS ord, md5(content) AS digest FROM rule")
def rule_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, ent = queries._links(spark, sf_dir)
    return graph.process_rules(links, ent.where(F.startswith("name", F.lit("part "))).select("name")).select("name", "ord", F.md5("content").alias("digest"))


@query("""SELECT source, seq, name FROM (SELECT 'rule' AS source, row_number() OVER (ORDER BY p_partkey) AS seq, p_name AS name FROM part UNION ALL SELECT 'llm', (SELECT count(*) FROM part) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier)""")
def combined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of rules, then those of the model, in one order."""
    rule = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"))
    model = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"))
    return entities.combine(rule, model, "place").select("source", "seq", "name")


# ---- retrieval and evaluation


@query(f"WITH {queries._SQL_BM25}, hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM score) SELECT CAST(query_id AS VARCHAR) AS query_id, CASE WHEN collection = 'templates' THEN 'template' ELSE 'vector' END AS source, CAST(rank AS INT) AS place FROM (SELECT query_id, collection, row_number() OVER (PARTITION BY query_id ORDER BY collection = 'templates', score DESC, rank) AS rank FROM hit WHERE rank <= 3)")
def degraded_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a graph: cases alone."""
    asked = queries._asked(spark, sf_dir).withColumn("chapter", F.lit(None).cast("string")).withColumn("processes", F.array(F.lit("p")))
    items = flows.answer(asked, None, queries._indexed(spark, sf_dir))
    return retrieve.subsets(items)[1].select("query_id", "source", "place")


@query(f"WITH {queries._SQL_BM25}, terms_of AS (SELECT file_id, len(t) AS dl FROM cjk) SELECT count(*) AS documents, CAST(sum(dl) AS BIGINT) AS words FROM terms_of")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of all terms: its documents and their words."""
    path = table_path(spark, "index")
    index.write_postings(queries._indexed(spark, sf_dir), path)
    nothing = spark.createDataFrame([], "term string")
    whole = spark.read.parquet(path)
    totals = index.read_postings(spark, path, nothing).agg(F.count(F.lit(1)).alias("documents"))
    return totals.crossJoin(whole.where("term <> ''").agg(F.sum("tf").cast("long").alias("words")))


_SQL_RANKS = queries._SQL_COSINE + """, truth AS (SELECT DISTINCT query_id, CASE query_id % 40 WHEN 0 THEN query_id + 1 ELSE -1 END AS pos FROM s),
top AS (SELECT query_id, min(id) FILTER (rank = 2) AS second FROM ranked WHERE rank <= 10 GROUP BY query_id)"""


@query(f"WITH {_SQL_RANKS} SELECT query_id, CAST(CASE WHEN query_id % 40 = 0 THEN 2 END AS INT) AS rank FROM top")
def positive_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the right passage: the second hit for every other query, and one that isn't there."""
    ranked = stage(queries._vectors(spark, sf_dir)[2], "ranked")
    truth = ranked.where("rank = 2").select("query_id", F.when(F.col("query_id") % 40 == 0, F.col("id")).otherwise(F.lit(-1)).alias("positive_id"))
    return evaluate.positive_ranks(ranked, truth)


_SQL_RERANK_METRICS = queries._SQL_RERANK + """, best AS (SELECT query_id, min(id) AS pos FROM ranked WHERE rank <= 10 GROUP BY query_id),
r AS (SELECT b.query_id, x.rank AS before, y.rank AS after FROM best b LEFT JOIN ranked x ON x.query_id = b.query_id AND x.id = b.pos LEFT JOIN reranked y ON y.query_id = b.query_id AND y.id = b.pos)"""


@query(f"""WITH {_SQL_RERANK_METRICS} SELECT count(*) AS queries, round(sum(CASE WHEN after <= 1 THEN 1.0::DOUBLE / after ELSE 0 END) / count(*), 6) AS mrr_1, round(sum(CASE WHEN after <= 3 THEN 1.0::DOUBLE / after ELSE 0 END) / count(*), 6) AS mrr_3,
  round(count(*) FILTER (after <= 1) / count(*), 6) AS hit_1, round(count(*) FILTER (after <= 3) / count(*), 6) AS hit_3,
  round(round(sum(CASE WHEN after <= 3 THEN 1.0::DOUBLE / after ELSE 0 END) / count(*), 6) - round(sum(CASE WHEN before <= 3 THEN 1.0::DOUBLE / before ELSE 0 END) / count(*), 6), 6) AS mrr_gain FROM r""")
def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics after reranking and the gain over the embedding, with the hit of the least id as the right one."""
    ranked = stage(queries._vectors(spark, sf_dir)[2], "ranked")
    truth = ranked.groupBy("query_id").agg(F.min("id").alias("positive_id"))
    before = evaluate.retrieval_metrics(evaluate.matched(evaluate.positive_ranks(ranked, truth), truth)).select(F.col("mrr_3").alias("embedding"))
    after = evaluate.positive_ranks(queries._reranked(spark, sf_dir), truth)
    return evaluate.rerank_metrics(after, F.lit(0.0)).crossJoin(before).withColumn("mrr_gain", F.round(vectors.gain(F.col("mrr_3"), F.col("embedding")), 6)).drop("embedding")


@query(f"WITH {queries._SQL_COSINE} SELECT r.query_id, r.id, CAST(length(text) AS INT) AS n_chars FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10 AND d.doc_id % 3 > 0 AND text <> ''")
def candidates_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise("").alias("content"))
    return evaluate.with_content(queries._vectors(spark, sf_dir)[2], docs).select("query_id", "id", F.length("content").alias("n_chars"))


@query("""SELECT event_type AS model, round(avg(value), 6) AS mrr_3 FROM events GROUP BY event_type ORDER BY mrr_3 DESC, model LIMIT 2""")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_models(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 6).alias("mrr_3")))


@query(f"""WITH {queries._SQL_FIRST}, t AS (SELECT query_id, min(rank) FILTER (rank <= 10) AS rank FROM (SELECT query_id, CASE WHEN id = pos THEN rank END AS rank FROM ranked JOIN (SELECT query_id AS q, max(id) AS pos FROM ranked WHERE rank <= 3 GROUP BY query_id) ON q = query_id) GROUP BY query_id) SELECT {queries._SQL_METRICS} FROM t""")
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of an embedding: search, ranks of the right passages, metrics."""
    v = table(spark, sf_dir, "embeddings")
    asked, passages = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("id"), "embedding")
    truth = evaluate.cosine_topk(asked, passages, 3).groupBy("query_id").agg(F.max("id").alias("positive_id"))
    return evaluate.evaluate(asked, passages, truth)


# ---- outside models, by stand-ins


@query(r"""SELECT doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents""")
def clean_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that returns what it gets, behind an opening."""

    def polite():
        return lambda text: f"Here is the text:\n{text}"

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return external.clean_by_model(docs, polite, size=1 << 30).select("doc_id", F.md5("text").alias("digest"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1500 THEN 'high' WHEN length(text) > 300 THEN 'medium' ELSE 'low' END AS density, least(length(text), 3000) || ' characters' AS density_reason FROM documents""")
def grade_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return external.grade_by_model(docs, external.length_grader).select("doc_id", "density", "density_reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'high' WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 30 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 'low' ELSE 'medium' END AS density, doc_id % 2 = 1 AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 30 AS is_refined FROM documents WHERE length(text) <= 3000""")
def refine_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") <= 3000).select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium").alias("density"))
    return external.refine_by_model(docs, external.echo_client).select("doc_id", "density", "is_refined")


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies with an entity, a relation, ones of unknown types and without names; every fifth holds no JSON."""
    reply = F.concat(
        F.lit('So: {"entities": [{"type": "process", "name": " '), "p_name", F.lit('", "attributes": {"size": "'), F.col("p_size").cast("string"), F.lit('"}}, {"type": "other", "name": "x"}, {"type": "hazard", "name": " "}], "relations": [{"type": "produces_hazard", "source": "'),
        "p_name", F.lit('", "target": "'), "p_type", F.lit('", "evidence": "e"}, {"type": "likes", "source": "a", "target": "b"}]}'),
    )
    content = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(reply)
    fragments = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("pos"), F.col("p_brand").alias("engineering_type"), content.alias("content"))
    return external.extract_by_model(fragments, external.echo_client, pause=0.0)


@query("""SELECT p_partkey AS id, 'process' AS type, p_name AS name, p_brand AS engineering_type, CAST(p_size AS VARCHAR) AS size, 'llm' AS source FROM part WHERE p_partkey % 5 > 0""")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir)[0].select("id", "type", "name", "engineering_type", F.col("attributes")["size"].alias("size"), "source")


@query("""SELECT p_partkey AS id, p_name AS source, p_type AS target, 'produces_hazard' AS relation_type, 'e' AS evidence FROM part WHERE p_partkey % 5 > 0""")
def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir)[1].select("id", "source", "target", "relation_type", "evidence")


@query("""SELECT p_partkey AS id, 'no JSON object in: ' || p_name AS error FROM part WHERE p_partkey % 5 = 0""")
def extract_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir)[2]


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'json' ELSE 'text' END AS kind, CASE WHEN c_custkey % 3 < 2 THEN c_name ELSE '' END AS project_name, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 2 END AS errors FROM customer""")
def parse_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as it is, and text through a model; some of both without what is needed."""
    data = F.when(F.col("c_custkey") % 3 < 2, F.concat(F.lit('{"basic": {"project_name": "'), "c_name", F.lit('"}}'))).otherwise("{}")
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, data).otherwise(F.concat(F.lit("Read this: "), data)).alias("source"))
    return external.parse_inputs(sources, external.echo_client).select("id", "kind", "input.basic.project_name", F.size("errors").alias("errors"))


_TASK = external.TASKS[6].replace("'", "''")


@query(f"""SELECT s_suppkey, md5('# 六、施工方法及工艺要求' || chr(10) || '{_TASK}' || chr(10) || 'Project: ' || s_name || ' (line), ' || s_nationkey || chr(10) || 'Rules:' || chr(10) || '- r1' || chr(10) || '- r2' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'Cases:' || chr(10) || '- ' || s_name ELSE '' END || chr(10)) AS digest FROM supplier""")
def generate_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that returns its prompt; heading and project name are put right."""
    none = F.array().cast("array<string>")
    contexts = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.lit("第六章 做法").alias("chapter_title"), F.lit("{工程名称}").alias("mark"), F.col("s_name").alias("project"), F.lit("line").alias("kind"), F.col("s_nationkey").cast("string").alias("location"),
        F.array(F.lit("r1"), F.lit("r2")).alias("rules"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("{{工程名称}}"))).otherwise(none).alias("cases"), none.alias("outline"),
    )
    return external.generate_chapter(contexts, 6, external.echo_client).select("s_suppkey", F.md5("text").alias("digest"))


@query(r"""SELECT doc_id, md5(trim(substring(text, 1, 2000), ' ' || chr(9) || chr(10) || chr(13) || '"''“”')) AS digest FROM documents""")
def generate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def quoting():
        return lambda text: f'"{text}" \n'

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return external.generate_queries(docs, quoting).select("doc_id", F.md5("query").alias("digest"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 8 END AS size FROM benchmark")
def embed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that knows short vectors, and one that fails, whose texts get hash embeddings."""

    def model():
        return lambda texts: [[1.0, 2.0, 3.0]] * len(texts)

    def broken():
        def ask(texts):
            raise RuntimeError("down")

        return ask

    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    both = external.embed(items.where("item_id % 2 = 0"), model, size=8).unionByName(external.embed(items.where("item_id % 2 = 1"), broken, size=8))
    return both.select("item_id", F.size("embedding").alias("size"))


@query(f"SELECT item_id, CAST(length('<Instruct>: {rules.RERANK_INSTRUCTION}' || chr(10) || '<Query>: q' || chr(10) || '<Document>: ' || text) AS DOUBLE) AS rerank_score FROM benchmark")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scorer():
        return lambda texts: [float(len(t)) for t in texts]

    items = table(spark, sf_dir, "benchmark").select("item_id", F.lit("q").alias("query"), F.col("text").alias("content"))
    return external.score_pairs(items, scorer).select("item_id", "rerank_score")


@query("""SELECT s_suppkey, md5(CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || s_name ELSE '' END || chr(10) || chr(10) || 'what of ' || s_name) AS digest FROM supplier""")
def ask_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.concat(F.lit("what of "), "s_name").alias("question"))
    contexts = known.where("s_suppkey % 2 = 0").select("name", F.concat(F.lit("about "), "name").alias("context"))
    out = external.ask_graph(known, contexts, external.echo_client).join(known.select("s_suppkey", "name"), "name")
    return out.select("s_suppkey", F.md5("reply").alias("digest"))


@query(f"""WITH {queries._SQL_CLEAN} SELECT doc_id, unnest(['raw', 'regex', 'final']) AS stage, unnest([md5(text), md5(cleaned), md5(cleaned)]) AS digest FROM clean""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts of each document in a run without a model."""
    return flows.clean_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "stage", F.md5("text").alias("digest"))


@query("""SELECT doc_id, md5(replace(text, chr(10), chr(10) || chr(10))) AS digest FROM documents""")
def chunks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents put together again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.join_chunks(chunk.explode_chunks(docs, 300)).select("doc_id", F.md5("text").alias("digest"))
