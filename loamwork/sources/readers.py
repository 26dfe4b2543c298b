"""Sources. Schemas are always given; nothing is inferred."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.text import strip
from loamwork.plans import rules
from loamwork.storage import read_bytes
from loamwork.workers import ship

FRAGMENT = (
    "id STRING, source_doc INT, chapter STRING, chapter_id STRING, section STRING, engineering_type STRING, quality_rating INT, density STRING, "
    "density_reason STRING, is_refined BOOLEAN, tags ARRAY<STRING>, content STRING, raw_content STRING, char_count INT, has_table BOOLEAN, priority STRING, "
    "sub_section_id STRING, level INT"
)
ENTITY = "seq BIGINT, id STRING, type STRING, name STRING, aliases ARRAY<STRING>, engineering_type STRING, attributes MAP<STRING,STRING>, source STRING, confidence DOUBLE"
RELATION = "seq BIGINT, id STRING, source_entity_id STRING, target_entity_id STRING, relation_type STRING, confidence DOUBLE, evidence STRING, source_doc STRING"
EVAL_ITEM = "query_id STRING, query STRING, positive_id STRING, positive_chapter STRING, positive_engineering_type STRING, positive_char_count INT, hard_negatives ARRAY<STRUCT<id:STRING,type:STRING>>, human_verified BOOLEAN"


def project_fragments(fragments: DataFrame) -> DataFrame:
    """The columns that fragments are written with, in order; missing ones are null."""
    names = ("id", "source_doc", "chapter", "section", "engineering_type", "quality_rating", "tags", "density", "is_refined", "priority", "char_count", "has_table", "sub_section_id", "content", "raw_content")
    kinds = dict(part.split(" ") for part in FRAGMENT.split(", "))
    return fragments.select(*(F.col(n) if n in fragments.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names))


def read_documents(spark: SparkSession, template: str, ids: list[int]) -> DataFrame:
    """(doc_id, text) of whole files at ``template`` with ``{doc_id}``; missing ones are skipped."""
    reader = spark.read.option("ignoreMissingFiles", True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = []
    for i in ids:
        path = jvm.org.apache.hadoop.fs.Path(template.format(doc_id=i))
        if path.getFileSystem(conf).exists(path):
            paths.append(template.format(doc_id=i))
    if not paths:
        return spark.createDataFrame([], "doc_id INT, text STRING")
    head, tail = template.split("{doc_id}")
    pattern = rf"{_quoted(head)}(\d+){_quoted(tail)}$"
    text = reader.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return text.select(F.regexp_extract("path", pattern, 1).cast("int").alias("doc_id"), F.col("value").alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E" if text else ""


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, name, content) of the files of a folder with a suffix in either case, by name."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def read_markdown_folder(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """(name, stem, text) of the Markdown files of a folder, without blank ones and ``skip``."""
    text = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = text.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))
    return rows.where(~F.col("name").isin(*skip) & (strip(F.col("text")) != "")).withColumn("stem", F.regexp_replace("name", r"\.md$", ""))


def read_jsonl(spark: SparkSession, path: str, schema: str = FRAGMENT) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_fragments(spark: SparkSession, path: str, chapters: list[str] | None = None, densities: list[str] | None = None) -> DataFrame:
    """Fragments of some chapters and densities; the filters are part of the scan's plan."""
    rows = read_jsonl(spark, path)
    rows = rows.where(F.col("chapter").isin(*chapters)) if chapters else rows
    return rows.where(F.col("density").isin(*densities)) if densities else rows


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_chapters(spark: SparkSession, path: str | None = None) -> tuple[tuple, tuple[str, ...]]:
    """(chapters, exclusions) of a rule base as ``sections.map_title`` takes them, in the file's order.

    Without a path the built-in rules; where the file is missing the fallback, which has no patterns
    and no exclusions.
    """
    if path is None:
        return rules.CHAPTERS, rules.GLOBAL_EXCLUSIONS
    data = read_bytes(spark, path)
    if data is None:
        names = {c[0]: c[1] for c in rules.CHAPTERS}
        return tuple((i, names[i], exact, variant, (), ()) for i, exact, variant in rules.FALLBACK_RULES), ()
    base = json.loads(data)
    chapters = []
    for chapter, entry in base["chapters"].items():
        of = lambda kind, field, entry=entry: tuple(w for rule in entry["rules"] if rule["type"] == kind for w in rule.get(field, ()))
        chapters.append((chapter, entry["standard_name"], of("exact", "keywords"), of("variant", "keywords"), of("regex", "patterns"), tuple(entry.get("exclusions", ()))))
    excluded = base.get("global_exclusions", {})
    lists = excluded.values() if isinstance(excluded, dict) else [excluded]
    return tuple(chapters), tuple(pattern for patterns in lists for pattern in patterns)


def rule_rows(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(chapter_id, ord, standard_name, tier, n, keyword) of a rule base: the rules, and exclusions as a tier of their own."""
    rows = []
    for i, c in enumerate(load_chapters(spark, path)[0]):
        for tier, words in zip(("exact", "variant", "regex", "exclusion"), c[2:], strict=True):
            rows += [(c[0], i, c[1], tier, n, w) for n, w in enumerate(words)]
    return spark.createDataFrame(rows, "chapter_id STRING, ord INT, standard_name STRING, tier STRING, n INT, keyword STRING")


METRICS = "model_name STRING, model_short STRING, mrr_at_1 DOUBLE, mrr_at_3 DOUBLE, hit_at_1 DOUBLE, hit_at_3 DOUBLE, hit_at_10 DOUBLE"


def read_metrics(spark: SparkSession, folder: str, prefix: str = "result_") -> DataFrame:
    """(model, model_name, mrr_1, mrr_3, hit_1, hit_3, hit_10) of the metric files with a name prefix."""
    files = spark.read.schema(METRICS).option("multiLine", True).option("pathGlobFilter", f"{prefix}*.json").json(folder)
    return files.select(F.col("model_short").alias("model"), "model_name", *(F.col(c).alias(c.replace("_at", "")) for c in ("mrr_at_1", "mrr_at_3", "hit_at_1", "hit_at_3", "hit_at_10")))


def read_input(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """(path, name, content) of a file, or of the files of a folder with the suffix."""
    if path.lower().endswith(suffix):
        files = spark.read.format("binaryFile").load(path)
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return list_files(spark, path, suffix)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A persisted index; a filter on collection prunes its folders."""
    return spark.read.parquet(path)


def open_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def first_markdown(archive: bytes | None) -> str | None:
    """The first Markdown member of a ZIP archive; null where there is none or the archive is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive or b"")) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".md")]
            return z.read(names[0]).decode("utf-8") if names else None
    except (zipfile.BadZipFile, UnicodeDecodeError):
        return None


def unpack_markdown(files: DataFrame, content: str = "content") -> DataFrame:
    """``text`` of each ZIP in ``content``."""
    ship(files.sparkSession)
    unpack = F.pandas_udf(lambda s: s.map(first_markdown), "string")
    return files.withColumn("text", unpack(F.col(content)))


def convert_files(files: DataFrame, convert: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(path, text, error) by an outside converter that each task makes once; a failure is a row's error."""

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = convert()
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    texts.append(one(content))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  one file's failure must not end the others
                    texts.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def options(prefix: str, defaults: dict[str, str]) -> dict[str, str]:
    """Options from the environment with defaults."""
    return {k: os.environ.get(f"{prefix}{k.upper()}", v) for k, v in defaults.items()}
