"""Tolerant JSON: model replies and loosely filled inputs as typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions.text import strip

INPUT_SCHEMA = (
    "basic STRUCT<project_name:STRING,project_type:STRING,location:STRING,scale:STRING>,"
    "technical STRUCT<geology:STRING,climate:STRING,special_requirements:STRING>,"
    "participants STRUCT<owner:STRING,contractor:STRING,supervisor:STRING,designer:STRING>,"
    "constraints STRUCT<timeline:STRING,budget:STRING,risks:STRING>"
)
GRAPH_SCHEMA = "entities ARRAY<STRUCT<type:STRING,name:STRING,attributes:MAP<STRING,STRING>>>, relations ARRAY<STRUCT<type:STRING,source:STRING,target:STRING,evidence:STRING>>"
# Types that extraction may return, and grades of density.
ENTITY_TYPES = ("process", "equipment", "hazard", "safety_measure", "quality_point")
RELATION_TYPES = ("requires_equipment", "produces_hazard", "mitigated_by", "requires_quality_check")
GRADES = ("high", "medium", "low")


def _valid(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    bare = strip(text)
    return F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull(), bare)


def _fenced(text: Column) -> Column:
    """What stands between the first two code fences, without the fence's language."""
    parts = F.split(text, "```", -1)
    return F.when(F.size(parts) > 2, F.regexp_replace(F.get(parts, F.lit(1)), r"\A(?:json)?", ""))


def extract_json(text: Column) -> Column:
    """The JSON object of a reply: the whole reply, a fenced block, or the first to the last brace; else null."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))
    return F.coalesce(_valid(text), _valid(_fenced(text)), _valid(braces))


def require_json(text: Column) -> Column:
    """(json, error): the object of a reply, or why there is none; ``fail_on_error`` raises it."""
    found = extract_json(text)
    return F.struct(found.alias("json"), F.when(found.isNull(), F.concat(F.lit("no JSON object in: "), F.substring(F.coalesce(text, F.lit("")), 1, 200))).alias("error"))


def fail_on_error(json: Column) -> Column:
    """The object of ``require_json``; a row without one ends the query."""
    return F.when(json["error"].isNotNull(), F.raise_error(json["error"])).otherwise(json["json"])


def grade_of(reply: Column) -> Column:
    """(density, reason) of a grading reply: its JSON; else the first grade it names; else medium."""
    bare = strip(reply)
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(bare, r"(?s)\A[^\n]*\n", "")).otherwise(bare)
    bare = strip(F.regexp_replace(bare, r"(?s)```\z", ""))
    data = F.from_json(_valid(bare), "density STRING, reason STRING")
    named = F.coalesce(*(F.when(F.contains(F.lower(reply), F.lit(g)), F.lit(g)) for g in GRADES), F.lit("medium"))
    density = F.when(F.coalesce(data["density"], F.lit("medium")).isin(*GRADES), F.coalesce(data["density"], F.lit("medium"))).otherwise(F.lit("medium"))
    parsed = _valid(bare).isNotNull()
    unread = F.concat(F.lit("unparsed: "), F.substring(F.coalesce(reply, F.lit("")), 1, 100))
    return F.struct(F.when(parsed, density).otherwise(named).alias("density"), F.when(parsed, F.coalesce(data["reason"], F.lit(""))).otherwise(unread).alias("reason"), parsed.alias("parsed"))


def to_json_text(*fields: Column) -> Column:
    """The fields as one JSON object, characters unescaped, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def standard_input(text: Column) -> Column:
    """A loosely filled input as the standard nested struct: missing parts empty, risks a list or empty."""
    data = F.from_json(text, INPUT_SCHEMA)
    part = lambda group, names: F.struct(*(F.coalesce(data[group][n], F.lit("")).alias(n) for n in names)).alias(group)
    risks = F.coalesce(F.from_json(data["constraints"]["risks"], "ARRAY<STRING>"), F.array().cast("array<string>"))
    risks = F.when(F.startswith(strip(F.coalesce(data["constraints"]["risks"], F.lit(""))), F.lit("[")), risks).otherwise(F.array().cast("array<string>"))
    return F.struct(
        part("basic", ("project_name", "project_type", "location", "scale")),
        part("technical", ("geology", "climate", "special_requirements")),
        part("participants", ("owner", "contractor", "supervisor", "designer")),
        F.struct(F.coalesce(data["constraints"]["timeline"], F.lit("")).alias("timeline"), F.coalesce(data["constraints"]["budget"], F.lit("")).alias("budget"), risks.alias("risks")).alias("constraints"),
    )


def input_errors(standard: Column) -> Column:
    """Messages for required fields that are blank."""
    checks = [F.when(strip(standard["basic"][n]) == "", F.lit(f"basic.{n} is required")) for n in ("project_name", "project_type")]
    return F.filter(F.array(*checks), lambda m: m.isNotNull())


def input_kind(source: Column) -> Column:
    """How an input is read: json, pdf or text."""
    return F.when(F.startswith(strip(source), F.lit("{")), F.lit("json")).when(F.endswith(F.lower(source), F.lit(".pdf")), F.lit("pdf")).otherwise(F.lit("text"))


def graph_of(reply: Column) -> Column:
    """Entities and relations of an extraction reply, only of known types and with names."""
    data = F.from_json(extract_json(reply), GRAPH_SCHEMA)
    entities = F.filter(F.coalesce(data["entities"], F.array().cast("array<struct<type:string,name:string,attributes:map<string,string>>>")), lambda e: e["type"].isin(*ENTITY_TYPES) & (strip(F.coalesce(e["name"], F.lit(""))) != ""))
    relations = F.filter(
        F.coalesce(data["relations"], F.array().cast("array<struct<type:string,source:string,target:string,evidence:string>>")),
        lambda r: r["type"].isin(*RELATION_TYPES) & (strip(F.coalesce(r["source"], F.lit(""))) != "") & (strip(F.coalesce(r["target"], F.lit(""))) != ""),
    )
    return F.struct(entities.alias("entities"), relations.alias("relations"))
