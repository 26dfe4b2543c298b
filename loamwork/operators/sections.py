"""Sections: header split, tiered chapter rules, inheritance along a document, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import text as T
from loamwork.plans import rules

UNMAPPED, EXCLUDED = "unmapped", "excluded"
_HEADER = r"(?Umd)^(#{1,4})\s+(.+)$"


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, title, level, body): one row a Markdown header of level 1 to 4, body up to the next.

    Text before the first header is dropped; a document without headers has no rows. Splitting is
    within the row, so nothing is shuffled and no order is lost.
    """
    heads = F.regexp_extract_all(F.col(text_col), F.lit(_HEADER), F.lit(0))
    # a mark before each header cuts the text into bodies that begin with their header
    marked = F.regexp_replace(F.col(text_col), F.lit(_HEADER), F.lit("\x00$0\x01"))
    pieces = F.slice(F.split(marked, "\x00", -1), 2, F.greatest(F.size(heads), F.lit(1)))
    rows = docs.where(F.size(heads) > 0).select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("pos", "piece"))
    head = F.substring_index("piece", "\x01", 1)
    return rows.select(
        "doc_id", "pos", T.strip(F.regexp_extract(head, _HEADER, 2)).alias("title"), F.length(F.regexp_extract(head, _HEADER, 1)).alias("level"),
        T.strip(F.substring(F.col("piece"), F.length(head) + 2, F.length("piece"))).alias("body"),
    )


def _contains_any(title: Column, cleaned: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(cleaned, F.lit(w)) | F.contains(title, F.lit(w)), words, F.lit(False))


def map_title(title: Column, chapters=rules.CHAPTERS, exclusions=rules.GLOBAL_EXCLUSIONS, prefixes=rules.TITLE_PREFIXES) -> Column:
    """(chapter_id, chapter_name, confidence, match_type, keyword) of a title.

    Globally excluded titles first; then all chapters' exact words, then all variants, then all
    patterns. Within a tier chapters and words go in the order of the rules. A chapter's exclusions
    take it out of every tier. The rules are constants of the plan, so no join is needed.
    """
    cleaned = T.clean_title(title, prefixes)

    def result(chapter: str, name: str, confidence: float, kind: str, keyword: str) -> Column:
        return F.struct(F.lit(chapter).alias("chapter_id"), F.lit(name).alias("chapter_name"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("match_type"), F.lit(keyword).alias("keyword"))

    cases: list[tuple[Column, Column]] = []
    if exclusions:
        cases.append((T.found(title, "(?:" + "|".join(exclusions) + ")"), result(EXCLUDED, "", 1.0, "excluded", "global_exclusion")))
    for tier, kind, confidence in ((2, "exact", 1.0), (3, "variant", 0.8), (4, "regex", 0.8)):
        for chapter in chapters:
            free = ~_contains_any(title, cleaned, chapter[5]) if chapter[5] else F.lit(True)
            for word in chapter[tier]:
                hit = T.found(title, word) if kind == "regex" else _contains_any(title, cleaned, (word,))
                cases.append((free & hit, result(chapter[0], chapter[1], confidence, kind, word)))
    out = reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None)
    return out.otherwise(result(UNMAPPED, "", 0.0, UNMAPPED, "")) if cases else result(UNMAPPED, "", 0.0, UNMAPPED, "")


def inherit_chapters(sections: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Adds ``effective_chapter`` to (doc_id, pos, level, chapter_id): deeper sections inherit.

    The level of the current chapter is the least level of the mapped sections so far, as each
    mapped section at or above it takes over; the chapter is the last that did. Windows are by
    document, whose sections are few.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mapped = F.col("chapter_id") != UNMAPPED
    out = sections.withColumn("_level", F.coalesce(F.min(F.when(mapped, F.col("level"))).over(before), F.lit(99)))
    takes = mapped & (F.col("level") <= F.col("_level"))
    out = out.withColumn("_chapter", F.coalesce(F.last(F.when(takes, F.col("chapter_id")), ignorenulls=True).over(upto), F.lit(UNMAPPED)))
    now = F.when(takes, F.col("level")).otherwise(F.col("_level"))
    inherits = (F.col("level") > now) & (F.col("_chapter") != UNMAPPED)
    effective = F.when(inherits, F.col("_chapter")).when(mapped, F.col("chapter_id")).otherwise(F.col("_chapter"))
    return out.withColumn("effective_chapter", effective).drop("_level", "_chapter")


def map_document(titles: DataFrame, mapped: Column | None = None) -> DataFrame:
    """(doc_id, pos, title, level) with chapter_id, chapter_name, confidence and match_type after inheritance.

    Excluded titles keep their result and leave the state alone. A section below the current
    chapter's level inherits its confidence; one that is not, and has no chapter, inherits 0.7 of it.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = titles.withColumn("_m", map_title(F.col("title")) if mapped is None else mapped)
    direct = ~F.col("_m.chapter_id").isin(UNMAPPED, EXCLUDED)
    excluded = F.col("_m.match_type") == EXCLUDED
    out = out.withColumn("_level", F.coalesce(F.min(F.when(direct, F.col("level"))).over(before), F.lit(99)))
    takes = direct & (F.col("level") <= F.col("_level"))
    out = out.withColumn("_state", F.last(F.when(takes, F.col("_m")), ignorenulls=True).over(upto))
    deeper = ~excluded & ~takes & (F.col("level") > F.col("_level")) & F.col("_state").isNotNull()
    shallow = ~excluded & ~takes & ~deeper & ~direct & F.col("_state").isNotNull()
    inherits = deeper | shallow
    pick = lambda name: F.when(inherits, F.col(f"_state.{name}")).otherwise(F.col(f"_m.{name}"))
    confidence = F.when(deeper, F.col("_state.confidence")).when(shallow, F.col("_state.confidence") * 0.7).otherwise(F.col("_m.confidence"))
    return out.select(
        *titles.columns, pick("chapter_id").alias("chapter_id"), pick("chapter_name").alias("chapter_name"), confidence.alias("confidence"),
        F.when(inherits, F.lit("inherited")).otherwise(F.col("_m.match_type")).alias("match_type"),
    )


def coverage(results: DataFrame) -> DataFrame:
    """One row: total, mapped, excluded, unmapped, coverage_rate (0 where there is nothing)."""
    total = F.count(F.lit(1))
    excluded, unmapped = F.count_if(F.col("chapter_id") == EXCLUDED), F.count_if(F.col("chapter_id") == UNMAPPED)
    covered = total - unmapped
    return results.agg(
        total.alias("total"), (covered - excluded).alias("mapped"), excluded.alias("excluded"), unmapped.alias("unmapped"),
        F.when(total > 0, covered / total).otherwise(F.lit(0.0)).alias("coverage_rate"),
    )


def coverage_by(results: DataFrame, *columns: str) -> DataFrame:
    """Sections by chapter, match type, or what else."""
    return results.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def title_lists(results: DataFrame) -> DataFrame:
    """(chapter_id, doc_id, pos, title) of the unmapped and the excluded titles."""
    return results.where(F.col("chapter_id").isin(UNMAPPED, EXCLUDED)).select("chapter_id", "doc_id", "pos", "title")


def mapped_rate(results: DataFrame) -> DataFrame:
    """(doc_id, sections, mapped, rate): the share of a document's sections that have a chapter."""
    mapped = F.count_if(F.col("chapter_id") != UNMAPPED)
    return results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), mapped.alias("mapped"), (mapped / F.count(F.lit(1))).alias("rate"))


def two_tiers(chapters=rules.CHAPTERS) -> tuple:
    """The chapters with their exact words and variants alone, as the splitter knows them."""
    return tuple((c[0], c[1], c[2], c[3], (), ()) for c in chapters)


def map_title_detailed(title: Column, chapters=rules.CHAPTERS) -> Column:
    """(chapter_id, chapter_name, confidence, match_type, keyword) by exact words, then variants; no exclusions."""
    return map_title(title, two_tiers(chapters), (), rules.SPLITTER_PREFIXES)


def is_ambiguous(title: Column, mapping: Column, words=rules.BROAD_WORDS, most: int = 4) -> Column:
    """A title that is no more than a broad word, and was mapped by a keyword."""
    bare = T.clean_title(title, rules.SPLITTER_PREFIXES)
    return (mapping["keyword"] != "") & (F.length(bare) <= most) & bare.isin(*words)


def analyze_coverage(sections: DataFrame, mapping: Column | None = None, administrative: Column | None = None, k: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, keywords, ambiguous) of sections (doc_id, pos, title, body) by the two-tier rules.

    Totals: one row of administrative, sections, exact, variant and unmapped. Keywords: the ``k`` that
    map most titles, with the tier. Ambiguous: titles that are only a broad word.
    """
    mapping = map_title_detailed(F.col("title")) if mapping is None else mapping
    administrative = T.is_administrative(F.col("title"), F.col("body"), short_body=False) if administrative is None else administrative
    rows = sections.select("doc_id", "pos", "title", mapping.alias("m"), administrative.alias("a"))
    used, kind = rows.where("NOT a"), F.col("m.match_type")
    counted = lambda t: F.count_if(~F.col("a") & (kind == t)).alias(t)
    totals = rows.agg(F.count_if("a").alias("administrative"), F.count_if(~F.col("a")).alias("sections"), counted("exact"), counted("variant"), counted(UNMAPPED))
    hits = used.where("m.keyword <> ''").groupBy(F.col("m.keyword").alias("keyword"), kind.alias("match_type")).agg(F.count(F.lit(1)).alias("n"))
    unsure = used.where(is_ambiguous(F.col("title"), F.col("m"))).select("doc_id", "pos", "title", "m.chapter_id", "m.keyword")
    return totals, hits.orderBy(F.col("n").desc(), "keyword", "match_type").limit(k), unsure


def split_documents(docs: DataFrame, chapters=rules.CHAPTERS) -> DataFrame:
    """Sections ready for annotation: administrative ones dropped, chapters mapped by the two-tier rules and inherited."""
    found = split_sections(docs).where(~T.is_administrative(F.col("title"), F.col("body")))
    found = found.withColumn("_m", map_title_detailed(F.col("title"), chapters)).withColumn("chapter_id", F.col("_m.chapter_id"))
    names = F.create_map(*(F.lit(x) for c in chapters for x in (c[0], c[1])))
    out = inherit_chapters(found.drop("_m"))
    return out.select(
        "doc_id", "pos", "title", "level", "body", F.col("effective_chapter").alias("chapter_id"), F.coalesce(F.try_element_at(names, F.col("effective_chapter")), F.lit("")).alias("chapter"),
        T.sub_section_id(F.col("title")).alias("sub_section_id"), T.has_table(F.col("body")).alias("has_table"),
    )


def mapped_and_not(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections with a chapter, and the others, which are logged."""
    return sections.where(F.col("chapter_id") != UNMAPPED), sections.where(F.col("chapter_id") == UNMAPPED)


def chapter_headers(docs: DataFrame, skip=rules.NO_CHAPTER_WORDS, numbering=rules.CHAPTER_NUMBERING) -> DataFrame:
    """(doc_id, pos, level, title, name): headers of level 1 to 3 that may be chapters, their numbering taken off."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw")).withColumn("raw", T.strip(F.col("raw")))
    pattern = r"(?Ud)\A(#{1,3})\s+(.+)\z"
    heads = lines.where(F.col("raw").rlike(pattern)).select("doc_id", "pos", F.length(F.regexp_extract("raw", pattern, 1)).alias("level"), T.strip(F.regexp_extract("raw", pattern, 2)).alias("title"))
    heads = heads.where(T.hits(F.lower("title"), skip) == 0)
    return heads.withColumn("name", T.clean_title(F.col("title"), numbering)).where("name <> ''")


def corpus_summary(titles: DataFrame) -> DataFrame:
    """One row: documents with headers, headers, level-1 headers, the deepest level, and means a document."""
    per = structure_summary(titles)
    return per.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("headers").alias("headers"), F.sum("chapters").alias("chapters"), F.max("max_level").alias("max_level"),
        F.avg("headers").alias("mean_headers"), F.avg("chapters").alias("mean_chapters"),
    )


def structure_summary(titles: DataFrame) -> DataFrame:
    """By document: number of headers, of level-1 headers, and the deepest level."""
    return titles.groupBy("doc_id").agg(F.count(F.lit(1)).alias("headers"), F.count_if(F.col("level") == 1).alias("chapters"), F.max("level").alias("max_level"))


def chapter_frequency(titles: DataFrame, mandatory: int = 12, common: int = 6, name: Column | None = None) -> DataFrame:
    """(name, n, variants, documents, share, band): level-1 names by frequency; ``share`` of the documents with headers."""
    tops = titles.withColumn("name", T.normalize_chapter_name(F.col("title")) if name is None else name)
    total = titles.agg(F.count_distinct("doc_id").alias("total"))
    n = F.count(F.lit(1))
    out = tops.where("level = 1").groupBy("name").agg(n.alias("n"), F.count_distinct("title").alias("variants"), F.count_distinct("doc_id").alias("documents"))
    out = out.withColumn("band", F.when(F.col("n") >= mandatory, "mandatory").when(F.col("n") >= common, "common").otherwise("optional"))
    return out.crossJoin(total).withColumn("share", F.col("documents") / F.col("total")).drop("total")


def second_level(titles: DataFrame, name: Column | None = None) -> DataFrame:
    """(chapter, name, n): level-2 names by the level-1 name before them."""
    named = titles.withColumn("name", T.normalize_chapter_name(F.col("title")) if name is None else name)
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    under = named.withColumn("chapter", F.last(F.when(F.col("level") == 1, F.col("name")), ignorenulls=True).over(upto))
    return under.where("level = 2 AND chapter IS NOT NULL").groupBy("chapter", "name").agg(F.count(F.lit(1)).alias("n"))


def opening_chapters(titles: DataFrame, places: int = 3, k: int = 5, name: Column | None = None) -> DataFrame:
    """(place, name, n): the ``k`` most common names of the first, second and third chapter of documents."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    named = titles.where("level = 1").withColumn("name", T.normalize_chapter_name(F.col("title")) if name is None else name)
    counts = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places).groupBy("place", "name").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("place").orderBy(F.col("n").desc(), "name"))
    return counts.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")


def enclosing_chapter(titles: DataFrame) -> DataFrame:
    """Level-2 headers with the level-1 header last before them: an as-of lookup by window."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = titles.withColumn("parent", F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(upto))
    return out.where("level = 2 AND parent IS NOT NULL").select("doc_id", "pos", "parent", "title")


def nth_chapter(titles: DataFrame, n: int) -> DataFrame:
    """The ``n``-th level-1 header of each document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return titles.where("level = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == n).select("doc_id", "title")
