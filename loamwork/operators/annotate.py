"""Fragment annotation, grading, ids, order and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import jsonio
from loamwork.functions import text as T
from loamwork.plans import rules


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def top_tags(text: Column, keywords=rules.TAG_KEYWORDS, n: int = 5) -> Column:
    """The keywords that occur most, ties in the order of the list."""
    found = F.array(*(F.struct((-T.occurrences(text, k)).alias("c"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keywords)))
    ranked = F.array_sort(F.filter(found, lambda x: x["c"] < 0))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["k"])


def infer_type(title: Column, body: Column, default: Column, table=rules.TYPE_KEYWORDS, least: int = 2) -> Column:
    """The type with most keywords in title and 500 characters of the body, if ``least`` or more; ties by order."""
    text = F.concat(title, F.lit(" "), F.substring(body, 1, 500))
    scores = F.array(*(F.struct((-T.hits(text, words)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table)))
    best = F.array_min(scores)
    return F.when(-best["s"] >= least, best["name"]).otherwise(default)


def annotate(sections: DataFrame) -> DataFrame:
    """Fragments from mapped sections (unmapped ones are dropped)."""
    kept = sections.where(F.col("chapter_id") != "unmapped")
    doc = F.col("doc_id").cast("int")
    return kept.select(
        F.col("doc_id").alias("source_doc"), "pos", "chapter", "chapter_id", F.col("title").alias("section"),
        infer_type(F.col("title"), F.col("body"), _lookup(rules.DOC_TYPES, doc, rules.UNKNOWN_TYPE)).alias("engineering_type"),
        _lookup(rules.DOC_QUALITY, doc, rules.UNKNOWN_QUALITY).alias("quality_rating"), top_tags(F.col("body")).alias("tags"),
        F.col("body").alias("content"), F.col("body").alias("raw_content"), F.length("body").alias("char_count"), "has_table",
        _lookup(rules.PRIORITIES, F.col("chapter_id"), "P3").alias("priority"), "sub_section_id", "level",
    )


def grade(fragments: DataFrame, reply: Column) -> DataFrame:
    """Density from a grader's reply."""
    got = jsonio.grade_of(reply)
    return fragments.withColumn("density", got["density"]).withColumn("density_reason", got["reason"])


def refine(fragments: DataFrame, rewritten: Column, least: int = rules.REFINE_MIN_CHARS) -> DataFrame:
    """Medium fragments take the rewritten text; a too short one makes them low; none leaves them."""
    clean = T.strip(F.coalesce(rewritten, F.lit("")))
    asked = (F.col("density") == "medium") & (clean != "")
    good, short = asked & (F.length(clean) >= least), asked & (F.length(clean) < least)
    return fragments.select(
        *(c for c in fragments.columns if c not in ("content", "density", "char_count", "is_refined")),
        F.when(good, clean).otherwise(F.col("content")).alias("content"),
        F.when(short, F.lit("low")).otherwise(F.col("density")).alias("density"),
        F.length(F.when(good, clean).otherwise(F.col("content"))).alias("char_count"),
        good.alias("is_refined"),
    )


def number_fragments(fragments: DataFrame, doc: str = "source_doc", chapter: str = "chapter_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``id`` docNN_chX_sMM: fragments of a chapter of a document in order."""
    n = F.row_number().over(Window.partitionBy(doc, chapter).orderBy(*order))
    return fragments.withColumn("id", F.format_string("doc%02d_%s_s%02d", F.col(doc), F.lower(F.col(chapter)), n))


def order_fragments(fragments: DataFrame) -> DataFrame:
    """By priority, then document, then position."""
    return fragments.orderBy(F.coalesce(_lookup({"P0": 0, "P1": 1, "P2": 2, "P3": 3}, F.col("priority"), 3), F.lit(3)), "source_doc", "pos")


def stratified_sample(rows: DataFrame, stratum: str, size: str, key: str, quotas: DataFrame, long_chars: int = 512, seed: str = "42") -> DataFrame:
    """Up to ``quota`` rows a stratum, a third of them (one at least) long where there are long ones.

    ``quotas`` has (stratum, quota). The order is by md5 of key and seed, so the draw repeats. Ranks
    are limited early, so a large stratum isn't sorted in whole for a few rows.
    """
    usable = rows.where(F.col(size) > 10).join(quotas, stratum)
    usable = usable.withColumn("is_long", F.col(size) > long_chars)
    order = Window.partitionBy(stratum, "is_long").orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    ranked = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("quota"))
    longs = ranked.groupBy(stratum).agg(F.count_if("is_long").alias("n_long"))
    share = F.least(F.greatest(F.floor(F.col("quota") / 3), F.lit(1)), F.col("n_long"))
    taken = ranked.join(longs, stratum)
    return taken.where(F.when(F.col("is_long"), F.col("rank") <= share).otherwise(F.col("rank") <= F.col("quota") - share)).drop("rank", "n_long", "quota")


def top_up_long(sample: DataFrame, rows: DataFrame, size: str, key: str, chars: int, least: int, seed: str = "42") -> DataFrame:
    """The sample with further long rows until ``least`` rows are longer than ``chars``."""
    have = sample.where(F.col(size) > chars).count()
    if have >= least:
        return sample
    rest = rows.where(F.col(size) > chars).join(sample.select(key), key, "left_anti")
    more = rest.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(least - have)
    return sample.unionByName(more, allowMissingColumns=True)


def distributions(rows: DataFrame, *columns: str) -> DataFrame:
    """(kind, value, n): counts by each of the columns, in one pass by grouping sets."""
    counts = rows.select(*columns).groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_in_{c}") for c in columns))
    kind = F.coalesce(*(F.when(F.col(f"_in_{c}") == 0, F.lit(c)) for c in columns))
    value = F.coalesce(*(F.when(F.col(f"_in_{c}") == 0, F.col(c).cast("string")) for c in columns))
    return counts.select(kind.alias("kind"), value.alias("value"), "n")


def most_common(rows: DataFrame, column: str, order: str, k: int | None = None) -> DataFrame:
    """(value, n, first): values by count, those of equal count by where they come first in ``order``."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    ranked = counts.orderBy(F.col("n").desc(), "first")
    return ranked if k is None else ranked.limit(k)


def first_of_each(rows: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each value of ``by``; tasks keep only those before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= n)
