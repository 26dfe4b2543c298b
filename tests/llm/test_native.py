"""Source mixing and URL filters: SQL oracles and plain models."""

import random
import time

import pytest
from oracle import connection, same

from loamwork.llm import mixing, queries, urls


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    same(queries.queries()[name](spark, small), connection(small), queries.oracle_sql()[name])


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = 2.0 * sizes[s]
            full.add(s)
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in full)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])), rng.choice(["a", "b", "é", None, "hot", "hot", "hot", "hot"]), i) for i in range(600)]
    rows += [(None, "null id", "a", 1), (7, "again", "a", 2), (7, "again", "a", 2), (8, None, "empty", 3), (None, "null id", "a", 5), (None, "other", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    for c in ("source_size", "place", "dealt", "size_class", "copies", "before", "kept", "key", "n"):
        docs = docs.withColumn(c, docs["target"])
    sized = docs.withColumn("size", mixing.word_count(docs["text"]))
    got = mixing.mix(sized).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2 and r["place"] == r["dealt"] == r["kept"]
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = lambda pairs: sorted((d or -1, t or "") for d, t, n in pairs for _ in range(n))
    assert copies((r["doc_id"], r["text"], 1) for r in out.collect()) == copies((r["doc_id"], r["text"], r["copies"]) for r in got)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(sized.limit(0)).count() == 0
    other = mixing.mix(sized, seed=7).collect()
    assert sum(r["copies"] for r in other) > 0 and [r["copies"] for r in other] != [r["copies"] for r in got]


URLS = {
    "https://a.example.net/en/x": ("allow", "example.net/en/"), "http://EXAMPLE.com/de/": ("block", "example.com/de/"), "http://example.com/dex": ("allow", None), "http://x.net": ("allow", None),
    "http://x.net/": ("block", "net/"), "http://notexample.net/en/": ("block", "net/"), "http://w.org/fr/a?b#c": ("allow", "org/fr/"), "http://net/": ("block", "net/"), "nothing": ("allow", None),
    "http://x.net?/": ("allow", None), "": ("allow", None), "a://b.net/://c.org/fr/": ("block", "net/"), "http://" + "a." * 500 + "net/" + "p" * 3000: ("block", "net/"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, None, "http://x.net/", "http://x.net/"])] + [(3, "http://x.net/", "h")], "page_id long, url string, host string")
    got = urls.judge_urls(pages, urls.rule_table(spark)).collect()
    assert len(got) == pages.count()
    by = {r["page_id"]: (r["verdict"], r["rule"]) for r in got if r["page_id"] != 3}
    assert all(by[i] == want for i, want in enumerate(URLS.values()) if i != 3)
    assert by[len(URLS)] == ("allow", None)
    assert urls.judge_urls(pages, urls.rule_table(spark).limit(0)).where("rule IS NOT NULL").count() == 0
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    clash = urls.judge_urls(pages, urls.rule_table(spark), keep=("page_id", "host", "url"))
    assert clash.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and clash.count() == len(got)


def test_many_rule_shapes(spark):
    rng = random.Random(3)
    rules = {}
    for _ in range(1200):
        host = ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        rules[host, "/" + "x" * rng.randint(0, 90)] = rng.choice(["block", "allow"])
    table = spark.createDataFrame([(a, h, p) for (h, p), a in rules.items()], "action string, host string, path string")
    pages = []
    for i in range(200):
        host, path = rng.choice(list(rules))
        pages.append((i, f"http://{rng.choice(['', 'a.', 'zz.'])}{host}{path}{rng.choice(['', 'x', '/', '?q'])}"))
    begin = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), table).collect()}
    assert time.perf_counter() - begin < 60
    for i, url in pages:
        host, slash, path = url[7:].partition("/")
        path = (slash + path).split("?")[0]
        fits = [(len(h + p), len(h), a == "block", h + p, a) for (h, p), a in rules.items() if f".{host}".endswith(f".{h}") and path.startswith(p)]
        assert got[i] == ((max(fits)[3], max(fits)[4]) if fits else (None, "allow"))
