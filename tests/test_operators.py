import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamwork.functions import jsonio
from loamwork.operators import annotate, dedup, entities, evaluate, graph, index, ranks, retrieve, sections, tables
from loamwork.plans import external, flows, rules
from loamwork.sources import readers


def test_title_tiers(spark):
    cases = {
        "第一章 编制依据": ("Ch1", "exact"), "工程概述": ("Ch2", "variant"), "安全施工质量管理": ("Ch7", "exact"), "目录": ("excluded", "excluded"), "编制人": ("unmapped", "unmapped"),
        "编制依据 编制单位": ("unmapped", "unmapped"), "第三章 施工管理及人员": ("Ch3", "regex"), "x": ("unmapped", "unmapped"), "质检部：": ("excluded", "excluded"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "title string")
    got = {r["title"]: (r["m"]["chapter_id"], r["m"]["match_type"]) for r in df.select("title", sections.map_title(F.col("title")).alias("m")).collect()}
    assert got == cases


def plain_inherit(rows):
    current, level, out = "unmapped", 99, []
    for chapter, depth in rows:
        if chapter != "unmapped" and depth <= level:
            current, level = chapter, depth
        if depth > level and current != "unmapped":
            out.append(current)
        else:
            out.append(chapter if chapter != "unmapped" else current)
    return out


def test_inheritance_against_a_plain_walk(spark):
    rng = random.Random(4)
    docs = {d: [(rng.choice(["unmapped", "unmapped", "A", "B"]), rng.randint(1, 4)) for _ in range(rng.randint(1, 20))] for d in range(60)}
    rows = [(d, i, level, ch) for d, seq in docs.items() for i, (ch, level) in enumerate(seq)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, level int, chapter_id string")
    got = {(r["doc_id"], r["pos"]): r["effective_chapter"] for r in sections.inherit_chapters(df).collect()}
    assert got == {(d, i): x for d, seq in docs.items() for i, x in enumerate(plain_inherit(seq))}


def test_split_documents(spark):
    text = "cover\n# 一、编制依据\nbody\n## 1.1 法规\n| a |\n|---|\n# 目录\nx\n# 六、施工方法\nconcrete"
    docs = spark.createDataFrame([(1, text), (2, "no headers"), (3, None)], "doc_id int, text string")
    got = sections.split_documents(docs).orderBy("pos").collect()
    assert [(r["title"], r["chapter_id"], r["sub_section_id"], r["has_table"]) for r in got] == [("一、编制依据", "Ch1", "1", False), ("1.1 法规", "Ch1", "1.1", True), ("六、施工方法", "Ch6", "6", False)]
    fragments = annotate.number_fragments(annotate.annotate(sections.split_documents(docs)))
    assert {r["id"] for r in fragments.collect()} == {"doc01_ch1_s01", "doc01_ch1_s02", "doc01_ch6_s01"}


def test_types_and_tags(spark):
    body = "混凝土浇筑，混凝土养护，模板"
    df = spark.createDataFrame([("t", body)], "title string, body string")
    r = df.select(annotate.top_tags(F.col("body")).alias("tags"), annotate.infer_type(F.col("title"), F.col("body"), F.lit("d")).alias("kind")).first()
    assert r["tags"] == ["混凝土", "模板", "浇筑", "养护"] and r["kind"] == "变电土建"


def plain_pairs(texts):
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    out = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            a, b = sets[i], sets[j]
            if (not a and not b) or 5 * len(a & b) > 4 * len(a | b):
                out.add((i, j))
    return out


def plain_greedy(n, pairs, quality, doc):
    gone = set()
    for i in range(n):
        if i in gone:
            continue
        for j in range(i + 1, n):
            if j not in gone and (i, j) in pairs:
                keep_i = quality[i] > quality[j] if quality[i] != quality[j] else doc[i] <= doc[j]
                gone.add(j if keep_i else i)
    return gone


@pytest.mark.parametrize("sample", [4096, 1])
def test_near_duplicates_against_plain_models(spark, monkeypatch, sample):
    monkeypatch.setattr(dedup, "SAMPLE", sample)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    texts = ["", None, "a", base] + ["".join(c if rng.random() > 0.03 else rng.choice("xyz") for c in base) for _ in range(30)] + ["abcab", "abcabc", base, base]
    rows = [("g", i, t, rng.randint(1, 3)) for i, t in enumerate(texts)] + [("h", 100 + i, t, 1) for i, t in enumerate(texts[:6])]
    df = spark.createDataFrame(rows, "grp string, id long, text string, q int")
    members, heads = dedup.similar_classes(df, "grp", "id", "text")
    assert members.count() == len(rows) and heads.where("a >= b").count() == 0
    got = dedup.all_pairs(members, heads, "grp")
    pairs = {(r["a"], r["b"]) for r in got.collect() if r["grp"] == "g"}
    assert pairs == plain_pairs([t or "" for t in texts])
    order = df.select("grp", F.col("id").alias("key"), F.col("q").alias("quality"), F.col("id").alias("doc"), F.col("id").alias("seq"))
    losers = {r["loser"] for r in dedup.greedy_losers(got, order, "grp").collect() if r["grp"] == "g"}
    assert losers == plain_greedy(len(texts), pairs, [r[3] for r in rows], list(range(len(texts))))
    assert dedup.similar_classes(df.limit(0), "grp", "id", "text")[1].count() == 0


@pytest.mark.parametrize("common", [1 << 14, 20, 0])
def test_similar_pairs_in_blocks(spark, monkeypatch, common):
    for name, value in (("COMMON", common), ("BLOCK", 700), ("LEAST", 5)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(17)
    texts, seen = [], []
    for i in range(12):
        base = [rng.choice("abcdefghij \u4e00\u4e8c\U0001f600" if i % 3 else "abcdef ") for _ in range(rng.randrange(5, 90))]
        texts += ["".join(c if rng.random() > 0.02 else rng.choice("xyz") for c in base) + "q" * rng.randrange(3) for _ in range(4)]
    stage = dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name, *level, **free: seen.append((name, out := stage(df, name, *level, **free))) or out)
    df = spark.createDataFrame([("g", f"k{i}", t) for i, t in enumerate(texts)], "grp string, id string, text string")
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    heads = {frozenset(s): min(f"k{j}" for j, o in enumerate(sets) if o == s) for s in sets}
    expected = {(x, y, len(s), len(o), len(s & o)) for s, x in heads.items() for o, y in heads.items() if x < y and 5 * len(s & o) > 4 * len(s | o)}
    got = dedup.similar_classes(df, "grp", "id", "text")[1].collect()
    assert expected and sorted(tuple(r)[1:] for r in got) == sorted(expected)
    tables = dict(seen)
    assert tables["meetings"].where("p < q").count() > 0
    # no table has a row for a pair that only might be similar
    assert max(t.count() for name, t in seen if name != "meetings") <= len(texts)


@pytest.mark.parametrize("sides", [1, 2])
def test_tiles_count_what_sets_share(monkeypatch, sides):
    for name, value in (("TILE", 4), ("COLUMNS", 16), ("MEETINGS", 9)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde" if i % 2 else "abcdefghijklmnop") for _ in range(rng.randrange(2, 60))) for i in range(41)]
    texts += [t + "ab" for t in texts]
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    digest, n, near, far = dedup._numbered(texts, {c: i for i, c in enumerate(dedup.pair_codes("abcdeabcbde").tolist())})
    side = [i % sides for i in range(len(texts))]
    table = pa.table({"side": side, "n": n, "near": pa.array(near, pa.binary()), "far": pa.array(far, pa.binary())})
    got = [(*sorted((int(x), int(y))), int(s)) for xs, ys, shared in dedup.block_pairs(table, 4, 5) for x, y, s in zip(xs, ys, shared, strict=True)]
    expected = [(i, j, len(a & b)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) > 4 * len(a | b) and (sides == 1 or side[i] != side[j])]
    assert expected and sorted(got) == sorted((j, i, s) for i, j, s in expected)


def test_greedy_removal_reads_pairs_in_order(spark):
    rng = random.Random(23)
    pairs = {g: {(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.1} for g in "gh"}
    quality = {g: [rng.randint(1, 3) for _ in range(40)] for g in "gh"}
    df = spark.createDataFrame([(g, i, j) for g in "gh" for i, j in pairs[g]], "grp string, a long, b long").repartition(3)
    order = spark.createDataFrame([(g, i, quality[g][i], i, i) for g in "gh" for i in range(40)], "grp string, key long, quality int, doc long, seq long")
    losers = dedup.greedy_losers(df, order, "grp")
    assert "FlatMapGroups" not in losers._jdf.queryExecution().toString()
    got = losers.collect()
    assert len(set(got)) == len(got)
    for g in "gh":
        assert {r["loser"] for r in got if r["grp"] == g} == plain_greedy(40, pairs[g], quality[g], list(range(40)))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def plain_fuzzy(names):
    live, i = [(n, set()) for n in names], 0
    while i < len(live):
        j = i + 1
        while j < len(live):
            if 0 < plain_edits(live[i][0], live[j][0]) <= 2:
                keep, drop = (i, j) if len(live[i][0]) <= len(live[j][0]) else (j, i)
                live[keep][1].update({live[drop][0]} | live[drop][1])
                live.pop(drop)
                i -= drop < i
            else:
                j += 1
        i += 1
    return {n: sorted(a) for n, a in live}


def test_fuzzy_merge_against_a_plain_walk(spark):
    """Names with and without partners, of two kinds; their gaps in the order matter for the walk."""
    rng = random.Random(9)
    groups = {}
    for kind in ("process", "hazard"):
        names = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(40)] + [rng.choice("xyz") * n for n in range(8, 30, 4)]
        rng.shuffle(names)
        groups[kind] = list(dict.fromkeys(names))
    rows = [(i * 7, kind, "通用", n, [], {}, "rule", 0.8) for kind, names in groups.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "seq long, type string, engineering_type string, name string, aliases array<string>, attributes map<string,string>, source string, confidence double")
    merged, names = entities.merge_fuzzy(df)
    got = merged.collect()
    for kind, plain in groups.items():
        assert {r["name"]: r["aliases"] for r in got if r["type"] == kind} == plain_fuzzy(plain)
    assert {r["old"] for r in names.collect()} == {a for kind in groups.values() for aliases in plain_fuzzy(kind).values() for a in aliases}


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = random.Random(10)
    names = list({"".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(250)})
    df = spark.createDataFrame([("g", n) for n in names], "grp string, name string")
    got = {(r["a"], r["b"]): r["distance"] for r in entities.fuzzy_pairs(df, ("grp",)).collect()}
    want = {(a, b): d for a in names for b in names if a < b and (d := plain_edits(a, b)) <= 2}
    assert got == want


def test_numbers_within_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(1000), f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, seq long, t string")
    got = {r["t"]: r["n"] for r in ranks.number(df, "seq", "n", ("g",), ("t",), span=50).collect()}
    want = {t: n for g in "ab" for n, (_, t) in enumerate(sorted((s, t) for x, s, t in rows if x == g), 1)}
    assert got == want


def test_exact_merge_and_ids(spark):
    rows = [
        (1, "process", "通用", "浇筑作业", ["b"], {"k": "1"}, "rule", 0.8), (2, "process", "通用", "浇筑", ["a", "浇筑"], {"k": "2", "m": "3"}, "llm", 0.7),
        (3, "hazard", "变电土建", "坠落", [], {}, "rule", 1.0), (4, "hazard", "变电土建", " ", [], {}, "rule", 1.0),
    ]
    df = spark.createDataFrame(rows, "seq long, type string, engineering_type string, name string, aliases array<string>, attributes map<string,string>, source string, confidence double")
    got = {r["name"]: r for r in entities.assign_entity_ids(entities.merge_exact(df)).collect()}
    assert set(got) == {"浇筑", "坠落"}
    r = got["浇筑"]
    assert (r["aliases"], r["attributes"], round(r["confidence"], 6), r["id"]) == (["a", "b"], {"k": "1", "m": "3"}, 0.9, "process_common_001")
    assert got["坠落"]["id"] == "hazard_civil_001"


def test_hazard_quality_and_reference_tables(spark):
    hazard = "## 2. A\n\n| 序号 | 活动 | 因素 | 事故 | 等级 | 措施 |\n|---|---|---|---|---|---|\n| 1 | p | h | acc | 高 | m |\n| 2 | p | | acc | 高 | m |\n\n### 5.1 有限空间\n| 序号 | 因素 | 事故 | 等级 | 措施 |\n|---|---|---|---|---|\n| 1 | gas | acc | 高 | vent |\n"
    docs = spark.createDataFrame([(1, hazard)], "doc_id int, text string")
    e, r = tables.hazard_facts(docs)
    assert {(x["type"], x["name"]) for x in e.collect()} == {("process", "p"), ("hazard", "h"), ("safety_measure", "m"), ("process", "有限空间"), ("hazard", "gas"), ("safety_measure", "vent")}
    assert {x["evidence"] for x in r.where("relation_type = 'produces_hazard'").collect()} == {"p → h → acc", "有限空间 → gas → acc"}
    quality = "### 4.1 主变\n| 工序 | W/H/S 点 | 要点 |\n|---|---|---|\n| s | W | q1 |\n\n## 2. 通病\n| 序号 | 薄弱 | 预防 |\n|---|---|---|\n| 1 | weak | q2 |\n\n### 6.1 x\n| 工序 | 要点 |\n|---|---|\n| t | q3 |\n"
    e, _ = tables.quality_facts(spark.createDataFrame([(1, quality)], "doc_id int, text string"))
    assert {(x["name"], x["engineering_type"]) for x in e.where("type = 'quality_point'").collect()} == {("q1", "变电电气"), ("q2", "变电土建"), ("q3", "特殊作业")}
    ref = "## 1. 灌注桩施工\n```\n1. 钻机就位 → 清孔\n```\n\n| 项 | 值 |\n|---|---|\n| 混凝土搅拌机 | x |\n## 2. 参数\n"
    e, r = tables.reference_facts(spark.createDataFrame([(1, "civil_works.md", ref)], "doc_id int, name string, text string"))
    names = {(x["type"], x["name"]) for x in e.collect()}
    assert {("process", "灌注桩施工"), ("process", "钻机就位"), ("process", "清孔"), ("equipment", "钻机"), ("equipment", "混凝土搅拌机")} <= names and ("process", "参数") not in names
    assert {(x["source"], x["target"]) for x in r.collect()} == {("钻机就位", "钻机")}


def _graph(spark):
    rows = [("a", "tool", "需要设备,工序设备", 1), ("a", "fall", "产生危险源,工序危险", 2), ("fall", "belt", "安全措施,控制措施,风险缓解", 3), ("q", "a", "质量控制,质量要点,质量检查", 4), ("a", "spark", "产生危险源,工序危险", 5)]
    return graph.undirected(spark.createDataFrame(rows, "src string, tgt string, keywords string, seq int"))


def test_process_chain_and_items(spark):
    names = spark.createDataFrame([("a",), ("missing",)], "name string")
    got = {r["name"]: r for r in graph.process_chain(_graph(spark), names).collect()}
    a = got["a"]
    assert (a["equipment"], a["hazards"], a["quality_points"], a["safety_measures"]) == (["tool"], ["fall", "spark"], ["q"], {"fall": ["belt"]})
    assert got["missing"]["equipment"] == []
    items = graph.rule_items(graph.process_chain(_graph(spark), names)).orderBy("ord").collect()
    assert [i["content"] for i in items] == ["工序「a」需要设备：tool", "工序「a」存在危险源：fall。安全措施：belt", "工序「a」存在危险源：spark", "工序「a」质量要点：q"]


def test_counts_and_rules_gather_no_measures(spark):
    names = spark.createDataFrame([("a",), ("missing",)], "name string")
    got = {r["name"]: r for r in graph.process_counts(_graph(spark), names).collect()}
    assert (got["a"]["hazards"], got["a"]["measured"], got["missing"]["measured"]) == (["fall", "spark"], 1, 0)
    items = lambda df: sorted(map(tuple, df.collect()))
    assert items(graph.process_rules(_graph(spark), names)) == items(graph.rule_items(graph.process_chain(_graph(spark), names)))
    # 300 processes that share a hazard of 300 measures: no column holds its measures once a process
    many = [(f"p{i}", "h", "产生危险源,工序危险", i) for i in range(300)] + [("h", f"m{i}", "安全措施,控制措施,风险缓解", 300 + i) for i in range(300)]
    links, asked = graph.undirected(spark.createDataFrame(many, "src string, tgt string, keywords string, seq int")), spark.createDataFrame([(f"p{i}",) for i in range(300)], "name string")
    counts = graph.process_counts(links, asked)
    assert {r["measured"] for r in counts.collect()} == {1} and "safety_measures" not in counts.columns
    assert {r["content"].count("、") for r in graph.process_rules(links, asked).collect()} == {299}


def test_edges_drop_dangling(spark):
    ent = spark.createDataFrame([("e1", "x"), ("e2", "y")], "id string, name string")
    rel = spark.createDataFrame([(1, "e1", "e2", "produces_hazard", "", 0.5, None), (2, "e1", "zz", "mitigated_by", "e", 1.0, "d")], "seq long, src_id string, tgt_id string, relation_type string, evidence string, confidence double, source_doc string")
    edges, dangling = graph.edges(rel, ent)
    e = edges.collect()
    assert [(r["src"], r["tgt"], r["description"], r["source_id"]) for r in e] == [("x", "y", "x → produces_hazard → y", "unknown")] and dangling.count() == 1
    assert graph.chunks(rel, ent).collect()[0]["content"] == "x → zz: e"


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([("f1", "templates", "[工程类型: A] crane work"), ("f2", "ch07_quality", "[工程类型: B] crane crane"), ("f3", "ch07_quality", "nothing else")], "file_id string, collection string, body string")
    asked = spark.createDataFrame([("q", "crane")], "query_id string, query string")
    hits = index.search(docs, asked)
    assert [r["file_id"] for r in hits.orderBy("rank").collect()] == ["f2", "f1"]
    filtered = index.search(docs, asked, kind_filter=index.matches_type(F.col("body"), F.lit("A")))
    assert [r["file_id"] for r in filtered.collect()] == ["f1"]
    queries = spark.createDataFrame([("q", None, ["a"]), ("r", "ch06_methods", ["a"])], "query_id string, chapter string, processes array<string>")
    fused = retrieve.fuse(spark, retrieve.regulations(queries, _graph(spark)), retrieve.cases(hits, docs)).where("query_id = 'q'").orderBy("place").collect()
    assert [r["priority"] for r in fused] == [1, 1, 1, 1, 2, 3]
    assert retrieve.fuse(spark, retrieve.regulations(queries, None), retrieve.cases(None, None)).count() == 0


def test_metrics(spark):
    placed = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 12)], "query_id int, rank int")
    r = evaluate.retrieval_metrics(placed).first()
    assert (r["mrr_1"], r["mrr_3"], r["hit_1"], r["hit_3"], r["hit_10"]) == (0.25, 0.333333, 0.25, 0.5, 0.5)
    bins = {x["bin"]: x["queries"] for x in evaluate.metrics_by_length(placed.withColumn("chars", F.col("query_id") * 512)).collect()}
    assert bins == {"<512": 1, "512-1024": 1, ">1024": 2}


def test_cosine_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = df.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    one = evaluate.cosine_topk(q, df, 4).collect()
    two = evaluate.cosine_topk(q, df, 4, block=2).collect()
    assert len(one) == 24 and sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_models_fall_back(spark):
    def broken():
        def ask(text):
            raise RuntimeError("down")

        return ask

    docs = spark.createDataFrame([(1, "a\n\nb")], "doc_id int, text string")
    assert external.clean_by_model(docs, broken, 3).first()["text"] == "a\n\nb"
    frag = spark.createDataFrame([("f", "x" * 400)], "id string, content string")
    assert external.grade_by_model(frag, broken).first()["density"] == "medium"
    assert external.grade_by_model(frag, external.length_grader).first()["density"] == "medium"
    sources = spark.createDataFrame([(1, '{"basic": {"project_name": "P", "project_type": "t"}}'), (2, "some text")], "id int, source string")
    got = {r["id"]: (r["kind"], r["input"]["basic"]["project_name"], len(r["errors"])) for r in external.parse_inputs(sources, external.echo_client).collect()}
    assert got == {1: ("json", "P", 0), 2: ("text", "", 2)}
    assert rules.MAX_TOKENS[6] == 6144


def test_rule_base_with_exclusions_and_fallback(spark, tmp_path):
    base = {"chapters": {"C1": {"standard_name": "n", "rules": [{"type": "exact", "keywords": ["k"]}, {"type": "regex", "patterns": ["^p"]}, {"type": "variant", "keywords": ["v"]}], "exclusions": ["not"]}}, "global_exclusions": {"a": ["x$"], "b": ["y"]}}
    (tmp_path / "rules.json").write_text(json.dumps(base))
    chapters, excluded = readers.load_chapters(spark, f"{tmp_path}/rules.json")
    assert chapters == (("C1", "n", ("k",), ("v",), ("^p",), ("not",)),) and excluded == ("x$", "y")
    df = spark.createDataFrame([("k",), ("not k",), ("pq",), ("kx",), ("o",)], "title string")
    got = {r["title"]: r["m"]["match_type"] for r in df.select("title", sections.map_title(F.col("title"), chapters, excluded).alias("m")).collect()}
    assert got == {"k": "exact", "not k": "unmapped", "pq": "regex", "kx": "excluded", "o": "unmapped"}
    fallback, none = readers.load_chapters(spark, f"{tmp_path}/missing.json")
    assert len(fallback) == 10 and fallback[0][2:] == (("编制依据",), ("编制说明", "编制目的", "编写依据"), (), ()) and none == ()
    assert readers.rule_rows(spark, f"{tmp_path}/rules.json").where("tier = 'exclusion'").first()["keyword"] == "not"


def test_prompts_are_strict(spark):
    row = spark.createDataFrame([("t", "p", "k", None, ["r"], [], [])], "chapter_title string, project string, kind string, location string, rules array<string>, cases array<string>, outline array<string>")
    with pytest.raises(ValueError, match="outline"):
        external.render_prompts(row.drop("outline"))
    with pytest.raises(Exception, match="location"):
        external.render_prompts(row).collect()
    for number in external.TASKS:
        prompt = external.render_prompts(row.fillna("l"), number).first()["prompt"]
        assert external.TASKS[number] in prompt and "- r" in prompt and "Cases" not in prompt


def test_required_json_ends_the_query(spark):
    df = spark.createDataFrame([("none here",)], "t string")
    with pytest.raises(Exception, match="no JSON object"):
        df.select(jsonio.fail_on_error(jsonio.require_json(F.col("t")))).collect()


def test_fragments_of_a_run(spark):
    text = "\n".join(f"# 第{c}章 施工方法 {c}\n" + f"混凝土浇筑第{i}段的说明。" * 40 for i, c in enumerate("一二三"))
    docs = spark.createDataFrame([(4, text + "\n# 其他\nx"), (5, "# 附录\ny")], "doc_id int, text string")
    fragments, unmapped = flows.build_fragments(docs)
    rows = fragments.collect()
    assert {r["chapter_id"] for r in rows} == {"Ch6"} and [r["title"] for r in unmapped.collect()] == ["附录"]
    assert all(r["id"].startswith("doc04_ch6_s0") and r["density"] in ("high", "medium") for r in rows)


def test_graph_of_a_run(spark):
    found = spark.createDataFrame([(1, "process", "通用", "浇筑作业", [], {}, "rule", 1.0), (2, "hazard", "通用", "高处坠落", [], {}, "llm", 0.8), (3, "process", "通用", "浇筑", [], {}, "llm", 0.8)], "seq long, type string, engineering_type string, name string, aliases array<string>, attributes map<string,string>, source string, confidence double")
    links = spark.createDataFrame([(1, "浇筑", "高处坠落", "produces_hazard", 1.0, "e", "d"), (2, "浇筑", "无", "mitigated_by", 1.0, "", "d")], "seq long, source string, target string, relation_type string, confidence double, evidence string, source_doc string")
    nodes, edges, chunks, dangling = flows.build_graph(found, links)
    assert {r["name"] for r in nodes.collect()} == {"浇筑", "高处坠落"} and [(r["src"], r["tgt"]) for r in edges.collect()] == [("浇筑", "高处坠落")]
    assert dangling.count() == 1 and chunks.first()["content"] == "浇筑 → 高处坠落: e"
