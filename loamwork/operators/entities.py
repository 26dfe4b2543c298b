"""Entities and relations: exact and fuzzy merging, relation dedup, ids."""

from __future__ import annotations

from bisect import bisect_right
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import normalize_name
from loamwork.operators.ranks import number
from loamwork.plans import rules
from loamwork.workers import ship


def merge_exact(entities: DataFrame) -> DataFrame:
    """One row a (type, engineering_type, normalised name): the first row with all aliases and attributes.

    Needs seq, type, engineering_type, name, aliases, attributes, source, confidence. Of an
    attribute the first value holds; several sources raise the confidence by 0.1 up to 1. Nameless
    entities go.
    """
    named = entities.withColumn("name", normalize_name(F.col("name"))).where("name <> ''")
    first = F.min_by(F.struct("source", "confidence"), "seq")
    pairs = F.array_sort(F.collect_list(F.struct("seq", "attributes")), lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0))
    merged = F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda seen, p: F.map_concat(seen, F.map_filter(F.coalesce(p["attributes"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(seen, k))),
    )
    out = named.groupBy("type", "engineering_type", "name").agg(
        F.min("seq").alias("seq"), first.alias("first"), F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))).alias("all"),
        F.count_distinct("source").alias("sources"), merged.alias("attributes"),
    )
    boosted = F.when(F.col("sources") > 1, F.least(F.lit(1.0), F.col("first.confidence") + rules.SOURCE_BOOST)).otherwise(F.col("first.confidence"))
    aliases = F.array_sort(F.array_remove(F.array_distinct("all"), F.col("name")))
    return out.select("seq", "type", "engineering_type", "name", aliases.alias("aliases"), "attributes", F.col("first.source").alias("source"), boosted.alias("confidence"))


def fuzzy_pairs(names: DataFrame, group: tuple[str, ...], name: str = "name", distance: int = rules.FUZZY_DISTANCE) -> DataFrame:
    """(*group, a, b, distance) with a < b of different names of a group within ``distance`` edits.

    The shorter name is cut into distance + 1 even parts, of which the edits leave one whole; it
    stands in the longer name at most ``distance`` places off. So names meet by an equi-join on
    group, length, part and its text, and no group is compared in whole.
    """
    one = names.select(*group, F.col(name).alias("x")).where("x IS NOT NULL").distinct()
    parts = distance + 1
    # part i of n characters begins at i * n / parts, rounded down
    begin = lambda n, i: F.floor(n * i / parts).cast("int")
    cut, asked = [], []
    for i in range(parts):
        n = F.length("x")
        cut.append(F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col("x"), begin(n, i) + 1, begin(n, i + 1) - begin(n, i)).alias("t")))
        for less in range(distance + 1):
            n = F.length("x") - less
            for off in range(-distance, distance + 1):
                at, size = begin(n, i) + off, begin(n, i + 1) - begin(n, i)
                key = F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col("x"), at + 1, size).alias("t"))
                asked.append(F.when((n >= 0) & (at >= 0) & (at + size <= F.length("x")), key))
    short = one.select(*group, F.col("x").alias("s"), F.explode(F.array(*cut)).alias("k")).select(*group, "s", "k.*")
    probes = F.array_distinct(F.filter(F.array(*asked), lambda k: k.isNotNull()))
    long = one.select(*group, F.col("x").alias("l"), F.explode(probes).alias("k")).select(*group, "l", "k.*")
    met = short.join(long, [*group, "n", "i", "t"]).where("s <> l").select(*group, F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    met = met.withColumn("distance", F.levenshtein("a", "b", distance))
    return met.where("distance > 0").select(*group, "a", "b", "distance")


def greedy_moves(partners: dict[int, list[int]], sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(dropped, keeper) in order, from the places of names and their later partners within the distance.

    A name's turn: it meets its partners behind a mark, which starts at itself and moves along. Of
    the two the longer one goes, and of equally long ones the later. If the name itself goes, the
    turn passes to the one behind it with the mark where it is, so some of that one's partners are
    passed over; a name without partners ends the turn. Turns never go back.
    """
    order, gone, moves, k = sorted(partners), set(), [], 0
    while k < len(order):
        turn = mark = order[k]
        while turn in partners and turn not in gone:
            behind = partners[turn]
            met = next((q for q in islice(behind, bisect_right(behind, mark), None) if q not in gone), None)
            if met is None:
                break
            mark = met
            moves.append((turn, met) if sizes[turn] > sizes[met] else (met, turn))
            gone.add(moves[-1][0])
            while turn in gone:
                turn += 1
        k = bisect_right(order, turn)
    return moves


def merge_fuzzy(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, name map): names within two edits of a group merged greedily into the shorter one.

    The order of the turns matters, so the pairs of a group, as numbers, are one task; names,
    aliases and attributes aren't gathered there. The survivor has the names and aliases of all that
    went into it, and the highest confidence. The map has a name's direct keeper; of several groups
    with one name the last one holds.
    """
    ship(entities.sparkSession)
    keys = ("type", "engineering_type")
    placed = number(entities, "seq", "place", keys)
    pairs = fuzzy_pairs(entities, keys)
    for end, out in (("a", "p"), ("b", "q")):
        pairs = pairs.join(placed.select(*keys, F.col("name").alias(end), F.col("place").alias(out), F.length("name").alias(f"{out}_size")), [*keys, end])
    pairs = pairs.select(*keys, "p", "q", "p_size", "q_size")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        partners: dict[int, list[int]] = {}
        sizes: dict[int, int] = {}
        for p, q, p_size, q_size in pdf[["p", "q", "p_size", "q_size"]].itertuples(index=False):
            partners.setdefault(min(p, q), []).append(max(p, q))
            partners.setdefault(max(p, q), [])
            sizes[p], sizes[q] = p_size, q_size
        moves = greedy_moves({p: sorted(set(qs)) for p, qs in partners.items()}, sizes)
        root: dict[int, int] = {}
        for dropped, keeper in reversed(moves):
            root[dropped] = root.get(keeper, keeper)
        return pd.DataFrame({"type": pdf["type"].iloc[0], "engineering_type": pdf["engineering_type"].iloc[0], "place": [d for d, _ in moves], "keeper": [k for _, k in moves], "root": [root[d] for d, _ in moves], "step": range(len(moves))})

    moved = pairs.groupBy(*keys).applyInPandas(run, "type string, engineering_type string, place long, keeper long, root long, step long")
    members = placed.join(moved, [*keys, "place"])
    more = members.groupBy(*keys, F.col("root").alias("place")).agg(F.flatten(F.collect_list(F.array_append("aliases", F.col("name")))).alias("more"), F.max("confidence").alias("highest"))
    left = placed.join(moved.select(*keys, "place"), [*keys, "place"], "left_anti").join(more, [*keys, "place"], "left")
    aliases = F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_sort(F.array_distinct(F.concat("aliases", "more"))))
    confidence = F.when(F.col("more").isNull(), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.greatest("confidence", "highest")))
    merged = left.select("seq", "type", "engineering_type", "name", aliases.alias("aliases"), "attributes", "source", confidence.alias("confidence"))
    first = entities.groupBy(*keys).agg(F.min("seq").alias("first"))
    kept = placed.select(*keys, F.col("place").alias("keeper"), F.col("name").alias("kept"))
    names = members.join(kept, [*keys, "keeper"]).join(first, [*keys])
    return merged, names.groupBy(F.col("name").alias("old")).agg(F.max_by("kept", F.struct("first", "step")).alias("name"))


def dedup_relations(relations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row a (source, target, relation_type): most confident, then longest evidence, then first.

    Needs seq, source, target, relation_type, confidence, evidence. ``names`` (old, name) renames
    endpoints first, in one step.
    """
    if names is not None:
        for end in ("source", "target"):
            table = names.select(F.col("old").alias(end), F.col("name").alias("_new"))
            relations = relations.join(table, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    best = F.max_by(F.struct(*(c for c in relations.columns if c not in ("source", "target", "relation_type"))), F.struct("confidence", F.length("evidence"), -F.col("seq")))
    out = relations.groupBy("source", "target", "relation_type").agg(best.alias("best"), F.min("seq").alias("first_seq"))
    return out.select("source", "target", "relation_type", "best.*", "first_seq")


def assign_entity_ids(entities: DataFrame) -> DataFrame:
    """``id`` {type}_{abbreviation}_{number}; numbers run within a type in order of seq."""
    table = F.create_map(*(F.lit(x) for pair in rules.TYPE_ABBREVIATIONS.items() for x in pair))
    made = number(entities, "seq", "_number", ("type",), ("engineering_type", "name"))
    return made.withColumn("id", F.format_string("%s_%s_%03d", "type", F.coalesce(F.try_element_at(table, F.col("engineering_type")), F.lit("unk")), "_number")).drop("_number")


def resolve_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with ``src_id`` and ``tgt_id``: the id of the last entity with that name or alias, else the name."""
    known = entities.select("seq", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    known = known.groupBy("name").agg(F.max_by("id", "seq").alias("id"))
    for end, out in (("source", "src_id"), ("target", "tgt_id")):
        relations = relations.join(known.select(F.col("name").alias(end), F.col("id").alias(out)), end, "left").withColumn(out, F.coalesce(out, end))
    return relations


def number_relations(relations: DataFrame, order: str = "first_seq") -> DataFrame:
    """``id`` rel_NNNN in order of first appearance, then of the ends."""
    made = number(relations, order, "_number", (), ("source", "target", "relation_type"))
    return made.withColumn("id", F.format_string("rel_%04d", "_number")).drop("_number")


def combine(rule: DataFrame, model: DataFrame, place: str) -> DataFrame:
    """Facts of rules, then those of a model, with their ``source`` and ``seq`` in one order; ``place`` orders each."""
    first = number(rule, place, "seq")
    second = number(model, place, "seq").crossJoin(rule.agg(F.count(F.lit(1)).alias("_n"))).withColumn("seq", F.col("seq") + F.col("_n")).drop("_n")
    return first.withColumn("source", F.lit("rule")).unionByName(second.withColumn("source", F.lit("llm")), allowMissingColumns=True)


def find_entity(entities: DataFrame, name: str, kind: str | None = None, engineering_type: str | None = None) -> DataFrame:
    """The first entity with a name or alias, of a type, and of an engineering type or the common one."""
    out = entities.where((F.col("name") == name) | F.array_contains("aliases", name))
    if kind:
        out = out.where(F.col("type") == kind)
    if engineering_type:
        out = out.where(F.col("engineering_type").isin(engineering_type, rules.COMMON_TYPE))
    return out.orderBy("seq").limit(1)


def merge_all(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations merged, with ids and resolved endpoints."""
    merged, names = merge_fuzzy(merge_exact(entities))
    known = assign_entity_ids(merged)
    return known, number_relations(resolve_endpoints(dedup_relations(relations, names), known))


def distributions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, value, n): entities by type and engineering type, relations by type; one pass a table."""
    kinds = F.array(F.struct(F.lit("entity_type").alias("kind"), F.col("type").alias("value")), F.struct(F.lit("engineering_type").alias("kind"), F.col("engineering_type").alias("value")))
    first = entities.select(F.explode(kinds).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    second = relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    return first.select("x.kind", "x.value", "n").unionByName(second.select(F.lit("relation_type").alias("kind"), F.col("relation_type").alias("value"), "n"))
