"""Outside models behind small adapters, with stand-ins that need no network.

A client is a function that a task makes once. Failures are handled in the row: Spark's task retry
would repeat the whole partition's calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import jsonio
from loamwork.functions import text as T
from loamwork.functions.vectors import hash_embedding
from loamwork.operators import annotate
from loamwork.operators.chunk import explode_chunks, join_chunks
from loamwork.plans import rules
from loamwork.storage import stage
from loamwork.workers import ship

Client = Callable[[str], str]

# Fixed value: the length to which a prompt's content is cut.
CONTENT_CHARS, QUERY_CHARS = 3000, 2000


def call_model(rows: DataFrame, prompt: str, client: Callable[[], Client], out: str = "reply", tries: int = 1, pause: float = 0.0) -> DataFrame:
    """Adds the model's reply to ``prompt``, or null and ``<out>_error`` after ``tries`` failures with growing pauses."""
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            replies, errors = [], []
            for text in pdf[prompt]:
                reply, error = None, None
                for attempt in range(tries):
                    try:
                        reply, error = ask(text), None
                        break
                    except Exception as failure:  # noqa: BLE001  a row's failure is its result
                        error = str(failure)
                        if attempt + 1 < tries and pause:
                            time.sleep(pause * (attempt + 1))
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(**{out: replies, f"{out}_error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(columns).mapInPandas(run, f"{fields}, `{out}` string, `{out}_error` string")


def clean_by_model(docs: DataFrame, client: Callable[[], Client], size: int = rules.CHUNK_SIZE) -> DataFrame:
    """(doc_id, text): chunks cleaned by a model and put together; a failed chunk stays as it is."""
    replied = call_model(explode_chunks(docs, size), "chunk", client)
    kept = F.when(F.col("reply").isNull(), F.col("chunk")).otherwise(T.post_process(F.col("reply")))
    return join_chunks(replied.select("doc_id", "pos", kept.alias("chunk")))


def grade_by_model(fragments: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """Density by a model; a failed call is medium."""
    asked = fragments.withColumn("_prompt", F.substring("content", 1, CONTENT_CHARS))
    replied = call_model(asked, "_prompt", client, "_reply")
    got = jsonio.grade_of(F.coalesce("_reply", F.lit("")))
    return replied.withColumn("density", F.when(F.col("_reply").isNull(), F.lit("medium")).otherwise(got["density"])).withColumn("density_reason", F.coalesce("_reply_error", got["reason"])).drop("_prompt", "_reply", "_reply_error")


def refine_by_model(fragments: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """Medium fragments rewritten by a model; a failed call or an empty reply leaves one as it is."""
    medium = fragments.where("density = 'medium'").withColumn("_prompt", F.substring("content", 1, CONTENT_CHARS))
    replied = call_model(medium, "_prompt", client, "_reply").drop("_prompt", "_reply_error")
    rest = fragments.where("density IS NULL OR density <> 'medium'").withColumn("_reply", F.lit(None).cast("string"))
    return annotate.refine(replied.unionByName(rest), F.col("_reply")).drop("_reply")


def extract_by_model(fragments: DataFrame, client: Callable[[], Client], tries: int = 3, pause: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, failures) of fragments (id, pos, engineering_type, content), in a fixed order.

    Failures (id, error) are the fragments whose every try failed or whose reply held no JSON; the replies are a table
    between the steps, so that a model is asked once.
    """
    asked = fragments.select("id", "pos", "engineering_type", F.substring("content", 1, CONTENT_CHARS).alias("_prompt"))
    graph = jsonio.graph_of(F.coalesce("reply", F.lit("")))
    replied = stage(call_model(asked, "_prompt", client, tries=tries, pause=pause), "replies")
    got = replied.select("id", "pos", "engineering_type", graph.alias("g"))
    read = jsonio.require_json(F.col("reply"))["error"]
    failures = replied.select("id", F.when(F.col("reply").isNull(), F.col("reply_error")).otherwise(read).alias("error")).where("error IS NOT NULL")
    e = got.select("id", "pos", "engineering_type", F.posexplode("g.entities").alias("item", "e"))
    r = got.select("id", "pos", F.posexplode("g.relations").alias("item", "r"))
    return (
        e.select("id", "pos", "item", "e.type", T.strip(F.col("e.name")).alias("name"), "engineering_type", "e.attributes", F.lit("llm").alias("source"), F.lit(0.8).alias("confidence")),
        r.select("id", "pos", "item", T.strip(F.col("r.source")).alias("source"), T.strip(F.col("r.target")).alias("target"), F.col("r.type").alias("relation_type"), F.col("r.evidence").alias("evidence"), F.lit(0.8).alias("confidence")),
        failures,
    )


def parse_inputs(sources: DataFrame, client: Callable[[], Client]) -> DataFrame:
    """(id, kind, input, errors) of sources (id, source): JSON is read, other text goes through a model; blank text has defaults."""
    kinds = sources.withColumn("kind", jsonio.input_kind(F.col("source")))
    direct = kinds.where("kind = 'json'").withColumn("json", F.col("source"))
    other = call_model(kinds.where("kind <> 'json'"), "source", client, tries=2).withColumn("json", jsonio.extract_json(F.col("reply"))).drop("reply", "reply_error")
    rows = direct.unionByName(other).withColumn("input", jsonio.standard_input(F.coalesce("json", F.lit("{}"))))
    return rows.select("id", "kind", "input", jsonio.input_errors(F.col("input")).alias("errors"))




#: What the nine chapters ask for, beside the parts that all prompts share.
TASKS = {
    1: "List the laws, standards and documents that the plan rests on, the project's own first.",
    2: "Describe the project: place, scale, ground, climate and what makes it difficult.",
    3: "Set out who does what: the site organisation, its posts and their duties.",
    4: "Set out the order of the works and the schedule with its milestones.",
    5: "List what has to be ready: documents, people, machines, materials and the site.",
    6: "Describe the process flow, the main methods, each step's technique and how it is accepted.",
    7: "Set out the quality goals, the control points, common faults and how they are avoided.",
    8: "List the hazards with their measures, the safety organisation and the site rules.",
    9: "Set out how emergencies are reported, handled and what is kept ready for them.",
}
_FIELDS = ("chapter_title", "project", "kind", "location", "rules", "cases", "outline")


def render_prompts(contexts: DataFrame, number: int = 6) -> DataFrame:
    """``prompt`` of a chapter from chapter_title, project, kind, location, rules, cases and outline (arrays).

    A column that isn't there is an error here, a null value one when the query runs: a prompt never
    has a gap. Empty lists leave their part out.
    """
    missing = [c for c in _FIELDS if c not in contexts.columns]
    if missing:
        raise ValueError(f"undefined in the prompt: {', '.join(missing)}")
    given = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"undefined in the prompt: {c}")))

    def part(head: str, c: str) -> Column:
        lines = F.array_join(F.transform(given(c), lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(given(c)) > 0, F.concat(F.lit(f"\n{head}:\n"), lines)).otherwise(F.lit(""))

    text = F.concat(
        F.lit("# "), given("chapter_title"), F.lit(f"\n{TASKS[number]}\nProject: "), given("project"), F.lit(" ("), given("kind"), F.lit("), "), given("location"),
        part("Rules", "rules"), part("Cases", "cases"), part("Earlier chapters", "outline"), F.lit("\n"),
    )
    return contexts.withColumn("prompt", text)


def generate_chapter(contexts: DataFrame, number: int, client: Callable[[], Client]) -> DataFrame:
    """``text`` of a chapter: prompt, model, standard title and project name."""
    replied = call_model(render_prompts(contexts, number), "prompt", client)
    return replied.withColumn("text", T.fill_project_name(T.normalize_chapter_title(F.col("reply"), number), F.col("project")))


def score_pairs(candidates: DataFrame, scorer: Callable[[], Callable[[list[str]], list[float]]], query: str = "query", document: str = "content") -> DataFrame:
    """``rerank_score`` of each candidate by a model that scores texts of ``rerank_pair``; null where it fails."""
    ship(candidates.sparkSession)
    asked = candidates.withColumn("_pair", T.rerank_pair(F.col(query), F.col(document)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for pdf in batches:
            try:
                scores = list(map(float, score(pdf["_pair"].tolist())))
            except Exception:  # noqa: BLE001  a batch's failure leaves its rows without a score
                scores = [None] * len(pdf)
            yield pdf.drop(columns="_pair").assign(rerank_score=pd.Series(scores, dtype=float, index=pdf.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields if f.name != "rerank_score")
    return asked.drop("rerank_score").mapInPandas(run, f"{fields}, rerank_score double")


def embed(rows: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", size: int = 1024) -> DataFrame:
    """``embedding`` of each text by a model that a task makes once; rows of a batch that it fails on get the hash embedding."""
    ship(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name != "embedding"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = model()
        for pdf in batches:
            try:
                found = [list(map(float, v)) for v in one(pdf[text].tolist())]
            except Exception:  # noqa: BLE001  the fallback below takes over
                found = [None] * len(pdf)
            yield pdf[names].assign(_found=pd.Series(found, dtype=object, index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    made = rows.select(names).mapInPandas(run, f"{schema}, _found array<float>")
    return made.withColumn("embedding", F.coalesce("_found", hash_embedding(F.col(text), size))).drop("_found")


def ask_graph(questions: DataFrame, contexts: DataFrame, client: Callable[[], Client], mode: str = "hybrid") -> DataFrame:
    """(question, reply) by a model that is told what the graph says about the name that is asked about.

    Modes: naive asks without the graph, the others (local, global, hybrid, mix) with ``contexts``
    (name, context).
    """
    if mode not in ("local", "global", "hybrid", "naive", "mix"):
        raise ValueError(f"unknown mode {mode}")
    known = questions.join(contexts, "name", "left")
    told = F.lit("") if mode == "naive" else F.coalesce("context", F.lit(""))
    asked = known.withColumn("_prompt", F.concat(told, F.lit("\n\n"), F.col("question")))
    return call_model(asked, "_prompt", client).select("question", "name", "reply", "reply_error")


def generate_queries(fragments: DataFrame, client: Callable[[], Client]) -> DataFrame:
    asked = fragments.withColumn("_prompt", F.substring("content", 1, QUERY_CHARS))
    return call_model(asked, "_prompt", client, "_reply").withColumn("query", T.strip_quotes(F.col("_reply"))).drop("_prompt", "_reply", "_reply_error")


def echo_client() -> Client:
    """A stand-in that returns its prompt."""
    return lambda text: text


def length_grader() -> Client:
    """A stand-in grader: long texts high, short ones low."""

    def grade(text: str) -> str:
        level = "high" if len(text) > 1500 else "medium" if len(text) > 300 else "low"
        return f'{{"density": "{level}", "reason": "{len(text)} characters"}}'

    return grade
