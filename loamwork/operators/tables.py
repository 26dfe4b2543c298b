"""Markdown tables and numbered sections as rows, and the rules that read facts from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import text as T
from loamwork.plans import rules

_NUMBERED = r"(?Umd)^(#{2,3})\s+(\d+(?:\.\d+)?)[.、]?\s+(.*)"


def numbered_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_id, content): content of "## 2." and "### 5.1" headers, header line included.

    Of sections with one number the last holds, at the place of the first.
    """
    marked = F.regexp_replace("text", _NUMBERED, "\x00$0")
    pieces = F.split(marked, "\x00", -1)
    rows = docs.select("doc_id", F.posexplode(pieces).alias("pos", "content")).where("pos > 0")
    rows = rows.withColumn("section_id", F.regexp_extract("content", _NUMBERED, 2))
    return rows.groupBy("doc_id", "section_id").agg(F.max_by("content", "pos").alias("content"), F.min("pos").alias("pos"))


def table_rows(docs: DataFrame, text: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, line, cells): data rows of Markdown tables; ``keep`` names one text.

    Rows count once a separator line came after the last line that is no table line. The separator
    is told by its first cell, so a row whose first cell is blank or dashes counts as one.
    """
    lines = docs.select(*keep, F.posexplode(F.split(T.strip(F.col(text)), r"\r?\n", -1)).alias("line", "raw")).withColumn("raw", T.strip(F.col("raw")))
    inside = F.startswith("raw", F.lit("|"))
    separator = inside & T.found(F.col("raw"), r"\A\|[\s\-:]+\|")
    before = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("inside", inside).withColumn("separator", separator)
    lines = lines.withColumn("last_separator", F.max(F.when(F.col("separator"), F.col("line"))).over(before)).withColumn("last_other", F.max(F.when(~F.col("inside"), F.col("line"))).over(before))
    data = lines.where("inside AND NOT separator AND last_separator IS NOT NULL AND (last_other IS NULL OR last_separator > last_other)")
    cells = F.transform(F.split("raw", r"\|", -1), T.strip)
    cells = F.when(F.get(cells, 0) == "", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)
    cells = F.when(F.try_element_at(cells, F.lit(-1)) == "", F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells)
    return data.select(*keep, "line", cells.alias("cells")).where(F.size("cells") > 0)




def _entity(ordinal: int, kind: str, name: Column, **attributes: Column) -> Column:
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v)]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("type"), name.alias("name"), table.alias("attributes"))


def _relation(ordinal: int, source: Column, target: Column, kind: str, evidence: Column) -> Column:
    return F.struct(F.lit(ordinal).alias("ordinal"), source.alias("source"), target.alias("target"), F.lit(kind).alias("relation_type"), evidence.alias("evidence"))


def _section_rows(docs: DataFrame, sections: tuple[str, ...] | None, but: tuple[str, ...] = ()) -> DataFrame:
    top = F.substring_index("section_id", ".", 1)
    found = numbered_sections(docs).withColumn("top", top)
    found = found.where(top.isin(*sections)) if sections else found.where(~top.isin(*but))
    sub_title = F.regexp_extract(F.substring("content", 1, 200), r"(?U)###?\s+[\d.]+\s+(.+)", 1)
    found = found.withColumn("sub_title", T.strip(sub_title)).withColumn("head", F.substring("content", 1, 500))
    keys = ("doc_id", "section_id", "pos", "top", "sub_title", "head")
    return table_rows(found, "content", keys)


def _map_of(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _facts(rows: DataFrame, entities: Column, relations: Column, engineering: Column, confidence: float) -> tuple[DataFrame, DataFrame]:
    base = rows.select("doc_id", "pos", "line", engineering.alias("engineering_type"), entities.alias("e"), relations.alias("r"))
    e = base.select("doc_id", "pos", "line", "engineering_type", F.explode("e").alias("e"))
    e = e.select("doc_id", "pos", "line", "e.ordinal", "e.type", "e.name", "engineering_type", "e.attributes", F.lit("rule").alias("source"), F.lit(confidence).alias("confidence"))
    r = base.select("doc_id", "pos", "line", F.explode("r").alias("r"))
    return e, r.select("doc_id", "pos", "line", "r.*", F.lit(confidence).alias("confidence"))


_NO_RELATIONS = "array<struct<ordinal:int,source:string,target:string,relation_type:string,evidence:string>>"


def hazard_facts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (process, hazard, measure) and relations of hazard tables with six or five columns."""
    rows = _section_rows(docs, tuple(rules.HAZARD_SECTIONS))
    at = lambda i: T.strip(F.get("cells", F.lit(i)))
    wide = F.size("cells") >= 6
    pick = lambda six, five: F.when(wide, at(six)).otherwise(at(five))
    process = F.when(wide, at(1)).otherwise(F.when(F.col("sub_title") != "", F.col("sub_title")).otherwise(F.lit("特殊作业")))
    rows = rows.where(F.size("cells") >= 5).select(
        "doc_id", "pos", "line", "top", process.alias("process"), pick(2, 1).alias("hazard"), pick(3, 2).alias("accident"), pick(4, 3).alias("risk"), pick(5, 4).alias("measure")
    ).where("hazard <> '' AND measure <> ''")
    p, h, a, m = (F.col(c) for c in ("process", "hazard", "accident", "measure"))
    entities = F.array(_entity(0, "process", p), _entity(1, "hazard", h, accident_type=a, risk_level=F.col("risk")), _entity(2, "safety_measure", m))
    relations = F.array(
        _relation(0, p, h, "produces_hazard", F.concat_ws(" → ", p, h, a)), _relation(1, h, m, "mitigated_by", F.concat(h, F.lit("("), a, F.lit(") → "), F.substring(m, 1, 50)))
    )
    return _facts(rows, entities, relations, _map_of(rules.HAZARD_SECTIONS, F.col("top")), 1.0)


def measure_facts(docs: DataFrame) -> DataFrame:
    """Safety measures of the first section's tables, with their scene."""
    rows = _section_rows(docs, ("1",)).where(F.size("cells") >= 2)
    measure = T.strip(F.get("cells", F.lit(1)))
    rows = rows.where(measure != "")
    scene = F.when(F.col("sub_title") != "", F.create_map(F.lit("scene"), F.col("sub_title"))).otherwise(F.create_map().cast("map<string,string>"))
    entity = F.struct(F.lit(0).alias("ordinal"), F.lit("safety_measure").alias("type"), measure.alias("name"), scene.alias("attributes"))
    return _facts(rows, F.array(entity), F.array().cast(_NO_RELATIONS), F.lit(rules.COMMON_TYPE), 0.9)[0]


def quality_facts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processes and quality points of three table layouts, and their relations."""
    rows = _section_rows(docs, None, but=("1", "3")).where(F.size("cells") >= 2)
    at = lambda i: T.strip(F.get("cells", F.lit(i)))
    three = F.size("cells") >= 3
    whs = three & F.contains("head", F.lit("W/H/S"))
    weak = ~whs & three & (F.col("top") == "2")
    process = F.when(weak, at(1)).otherwise(at(0))
    point = F.when(whs | weak, at(2)).otherwise(at(1))
    rows = rows.select("doc_id", "pos", "line", "top", "section_id", process.alias("process"), point.alias("point"), F.when(whs, at(1)).alias("whs")).where("process <> '' AND point <> ''")
    p, q = F.col("process"), F.col("point")
    attributes = F.when(F.col("whs").isNotNull(), F.create_map(F.lit("whs_point"), F.col("whs"))).otherwise(F.create_map().cast("map<string,string>"))
    quality = F.struct(F.lit(1).alias("ordinal"), F.lit("quality_point").alias("type"), F.substring(q, 1, 80).alias("name"), attributes.alias("attributes"))
    relations = F.array(_relation(0, p, F.substring(q, 1, 80), "requires_quality_check", F.concat(p, F.lit(" → "), F.substring(q, 1, 50))))
    kind = F.coalesce(_map_of(rules.QUALITY_SECTIONS, F.col("section_id")), _map_of(rules.QUALITY_SECTIONS, F.col("top")), F.lit(rules.COMMON_TYPE))
    return _facts(rows, F.array(_entity(0, "process", p), quality), relations, kind, 1.0)


def reference_facts(docs: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Processes of headings and flow charts, and the equipment that flow steps and tables name."""
    kind = F.coalesce(_map_of(rules.REFERENCE_TYPES, F.col(name)), F.lit(rules.COMMON_TYPE))
    docs = docs.withColumn("engineering_type", kind)
    heads = F.regexp_extract_all("text", F.lit(r"(?Umd)^##\s+\d+[.、]\s*(.+)"), F.lit(1))
    named = docs.select("doc_id", "engineering_type", F.posexplode(heads).alias("pos", "name")).withColumn("name", T.strip(F.col("name")))
    named = named.where(T.hits(F.col("name"), rules.NO_PROCESS_WORDS) == 0)
    processes = named.select("doc_id", F.lit(0).alias("part"), F.col("pos").cast("long").alias("place"), F.lit("process").alias("type"), "name", "engineering_type", F.lit(0.9).alias("confidence"))

    flows = F.regexp_extract_all("text", F.lit(r"(?s)```\n(.+?)\n```"), F.lit(1))
    steps = docs.select("doc_id", F.col(name).alias("file"), "engineering_type", F.posexplode(flows).alias("flow", "raw"))
    steps = steps.select("doc_id", "file", "engineering_type", "flow", F.posexplode(F.split("raw", "[→\n]", -1)).alias("pos", "step"))
    steps = steps.withColumn("step", T.strip(F.col("step"))).where(F.length("step") >= 2)
    steps = steps.withColumn("step", T.strip(T.sub(F.col("step"), r"\A\d+[.、)\s]+", ""))).where("step <> ''")
    place = (F.col("flow") * 100_000 + F.col("pos")).cast("long")
    step_rows = steps.select("doc_id", F.lit(1).alias("part"), place.alias("place"), F.lit("process").alias("type"), F.col("step").alias("name"), "engineering_type", F.lit(0.8).alias("confidence"))
    used = F.filter(F.array(*(F.regexp_extract("step", rf"[一-鿿]{{1,6}}{k}", 0) for k in rules.EQUIPMENT_KEYWORDS)), lambda e: e != "")
    tools = steps.select("doc_id", "file", "engineering_type", place.alias("place"), "step", F.explode(used).alias("name"))
    tool_rows = tools.select("doc_id", F.lit(1).alias("part"), "place", F.lit("equipment").alias("type"), "name", "engineering_type", F.lit(0.7).alias("confidence"))
    relations = tools.select(
        "doc_id", "place", F.col("step").alias("source"), F.col("name").alias("target"), F.lit("requires_equipment").alias("relation_type"),
        F.concat(F.lit("工艺流程: "), F.col("step")).alias("evidence"), F.col("file").alias("source_doc"), F.lit(0.7).alias("confidence"),
    )
    cells = table_rows(docs, "text", ("doc_id", "engineering_type")).select("doc_id", "engineering_type", "line", F.posexplode("cells").alias("pos", "cell"))
    listed = F.filter(F.array(*(F.regexp_extract("cell", rf"[A-Z]*[一-鿿]{{1,8}}{k}", 0) for k in rules.EQUIPMENT_KEYWORDS)), lambda e: F.length(e) >= 3)
    cell_rows = cells.select("doc_id", F.lit(2).alias("part"), (F.col("line") * 1000 + F.col("pos")).cast("long").alias("place"), F.lit("equipment").alias("type"), F.explode(listed).alias("name"), "engineering_type", F.lit(0.7).alias("confidence"))
    return processes.unionByName(step_rows).unionByName(tool_rows).unionByName(cell_rows), relations
