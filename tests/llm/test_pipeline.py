import corpus_pipeline as C
from pyspark.sql import functions as F

from loamwork.llm import decontaminate, mixing, toxicity
from loamwork.llm.common import connected_components


def test_stages_and_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, now = docs.columns, docs
    kept = {}
    for name, step in C.STAGES:
        after = step(spark, now, small)
        if name != C.STAGES[-1][0]:
            assert after.columns == columns
        kept[name] = after
        now = after.cache()
    model = toxicity.train(docs, labels)
    want = {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in kept["toxicity"].collect()} == want
    dedup = kept["simhash_near_dedup"].collect()
    assert len({r["text"] for r in dedup}) == len(dedup) and {r["doc_id"] for r in dedup} <= want
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(kept["simhash_near_dedup"], bench).collect()}
    assert {r["doc_id"] for r in kept["benchmark_decontamination"].collect()} == {r["doc_id"] for r in dedup} - leaks
    sized = kept["benchmark_decontamination"].select("source", "doc_id", mixing.word_count(F.col("text")).alias("size"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(sized).where("copies > 0").collect()}
    counts = {r["doc_id"]: r["count"] for r in kept["source_mixing"].groupBy("doc_id").count().collect()}
    assert counts == copies
    tokens = kept["token_output"].collect()
    assert len(tokens) == sum(copies.values())
    ordered = sorted(tokens, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert sorted(map(tuple, C.run(spark, small).collect())) == sorted(map(tuple, tokens))


def test_stages_on_odd_tables(spark, small, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns, long texts and empty tables go through every stage."""
    real = spark.read.parquet(f"{small}/documents.parquet")
    names = ("row_key", "key", "kept", "place", "copies", "target", "size", "score", "pii", "n", "start")
    odd = [(None, None, None), (None, "", "a"), (900, None, "a"), (901, "same words here", "a"), (901, "same words here", "a"), (901, "other words there", "b"), (None, "no id at all", None), (902, "long " * 60_000, "c")]
    extra = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = real.limit(40).select(extra.columns).unionByName(extra)
    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    kept = {}
    now = docs
    for name, step in C.STAGES:
        after = step(spark, now, small)
        if name != C.STAGES[-1][0]:
            assert after.columns == docs.columns and after.where("row_key <> 'x' OR n <> 'x'").count() == 0
        assert step(spark, now.limit(0), small).count() == 0
        now = kept[name] = after.cache()
    rows = [(r["doc_id"], r["text"]) for r in kept["simhash_near_dedup"].collect() if r["doc_id"] in (None, 900, 901, 902)]
    assert sorted(((d or 0), (t or "")[:10]) for d, t in rows) == [(0, "no id at a"), (900, ""), (901, "other word"), (901, "same words"), (902, "long long ")]
    assert kept["token_output"].count() == kept["source_mixing"].count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[103] == got[101] == 100 and 200 not in got
