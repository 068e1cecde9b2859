"""Queries on sources and on what goes around generation: readers, whole-source judgements, contexts of resolvers, task labels, skims, profiles and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, lex, structure
from ..generation import analysis
from ..generation.backend import Stub
from ..operators import capacity, detect, references
from ..operators.prefix import kept
from ..sources import readers
from . import sqltext as s
from .text_queries import docs, load, sections

LOOKUP = 160
SPLIT = r"\s+"


def _written(spark: SparkSession, rows: DataFrame, form: str) -> str:
    """Rows written in a format to the folder that driver and executors share, to be read back."""
    kept(spark.range(1))  # names the folder if the session has none
    path = f"{spark.sparkContext.getCheckpointDir()}/source-{uuid.uuid4().hex}.{form}"
    if form == "csv":
        # Values as they are: Spark would trim them, and a null would be quoted like an empty value.
        rows.write.csv(path, header=True, escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def read_jsonl(spark, sf_dir):
    """Chats written as lines of JSON and read back with the schema that the lines share."""
    rows = readers.jsonl(spark, _written(spark, load(spark, sf_dir, "conversations"), "jsonl"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def read_csv(spark, sf_dir):
    """Documents written as CSV, with line breaks in their texts, and read back as strings."""
    rows = readers.csv(spark, _written(spark, load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "csv"))
    return rows.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def dense_pages(spark, sf_dir):
    """Whether markup would do as native text of a paged document, had it so many pages."""
    p = load(spark, sf_dir, "pages").withColumn("n", (F.col("page_id") % 40).cast("int"))
    return p.select("page_id", capacity.usable_pages(F.coalesce("html", F.lit("")), F.col("n")).alias("usable"))


def source_sizes(spark, sf_dir):
    """Characters and rows that each source can give, and whether that is enough for a job."""
    g = load(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    g = g.withColumn("rows", capacity.rows_from_chars(F.col("chars"), 4))
    return g.withColumn("enough", gates.enough_source(F.col("chars"), F.col("rows")))


def detected(spark, sf_dir):
    """What chats are, as pairs of columns."""
    c = load(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"), F.col("text").alias("response"))
    found = [detect.detect(c), detect.detect(load(spark, sf_dir, "benchmark")), detect.detect_all([c, c])]
    rows = [(n, f["already_instruct"], f["format"], f["row_count"]) for n, f in zip(("chats", "benchmark", "chats twice"), found, strict=True)]
    return spark.createDataFrame(rows, "source string, already_instruct boolean, format string, rows long")


def lookup_contexts(spark, sf_dir):
    """What a resolver reads for a turn of a chat, cut to a limit."""
    c = load(spark, sf_dir, "conversations")
    some = F.array(F.struct(F.col("role").alias("title"), F.col("text").alias("text")))
    none = F.array().cast("array<struct<title:string,text:string>>")
    return c.select("conv_id", "turn", references.lookup_context(F.when(F.col("turn") % 3 > 0, F.col("text")), F.when(F.col("turn") % 2 == 0, some).otherwise(none), F.lower("text"), LOOKUP).alias("context"))


def reference_blocks(spark, sf_dir):
    """Answers with what a resolver found appended."""
    c = load(spark, sf_dir, "conversations")
    finding = lambda n, st, ex, ok: F.struct(F.lit(n).alias("reference"), st.alias("statement"), ex.alias("excerpt"), ok.alias("matched"))
    found = F.array(
        finding("section 2", F.col("role"), F.lit(None).cast("string"), F.col("turn") % 2 == 0),
        finding("figure 3", F.lit(""), F.substring("text", 1, 20), F.lit(True)),
        finding("table 4", F.lit("never"), F.lit("never"), F.lit(False)),
    )
    return c.select("conv_id", "turn", references.with_block(F.col("text"), found).alias("output"))


def task_labels(spark, sf_dir):
    """Labels of tasks that are told as sentences: a verb before the first words of each document."""
    d = docs(spark, sf_dir).select("doc_id", structure.first_sentence(F.col("cleaned")).alias("first"))
    verbs = F.array(*map(F.lit, VERBS))
    task = F.concat(F.get(verbs, (F.col("doc_id") % len(VERBS)).cast("int")), F.substring(F.coalesce("first", F.lit("")), 1, 60))
    return d.select("doc_id", analysis.task_labels(task).alias("label"))


def document_skim(spark, sf_dir):
    """Interior excerpts of a few long documents."""
    return analysis.skim(docs(spark, sf_dir).withColumnRenamed("cleaned", "text"))


def corpus_profile(spark, sf_dir):
    """A profile and personas by the deterministic stub."""
    seen = analysis.excerpts(docs(spark, sf_dir).withColumnRenamed("cleaned", "text"))
    profile, extra = analysis.infer_both(Stub(), seen)
    personas = analysis.default_personas(Stub(), [seen], profile, extra)
    rows = [("domain", profile.domain), *(("task", t) for t in profile.preferred_task_types), *((f"persona {p.level}", p.name) for p in personas)]
    return spark.createDataFrame(rows, "what string, value string")


def document_summaries(spark, sf_dir):
    """Summaries of all documents by the deterministic stub."""
    return analysis.summaries(sections(spark, sf_dir), Stub)


VERBS = ("Explain ", "outline the ", "Compare ", "list every measure of ", "List ", "define_", "Summarize ", "Help with ", "", "Evaluate ", "walk-")

QUERIES = {f.__name__: f for f in (read_jsonl, read_csv, dense_pages, source_sizes, detected, lookup_contexts, reference_blocks, task_labels, document_skim, corpus_profile, document_summaries)}

_HEAD = "case when length(trim(coalesce(p, ''))) > 0 then 'SAMPLED PASSAGE:' || chr(10) || trim(p) end"
_LADDER = " ".join(f"when {s.like('low', pattern)} then {s.q(label)}" for pattern, label in analysis.TASK_LABELS)

ORACLES = {
    "read_jsonl": "select conv_id, turn::bigint as turn, role, text from conversations",
    "read_csv": "select doc_id::varchar as doc_id, lang, source, md5(text) as text_md5 from documents",
    "dense_pages": """with p as (select page_id, coalesce(html, '') as t, (page_id % 40)::integer as n from pages), f as (select *, length(replace(t, chr(12), '')) as chars,
            len(list_filter(string_split(t, case when contains(t, chr(12)) then chr(12) else chr(10) || chr(10) end), lambda x: length(trim(x)) > 0)) as full_ from p)
        select page_id, case when n <= 0 then length(trim(t)) > 0 else chars / n >= 40 and full_ / n >= 0.2 end as usable from f""",
    "source_sizes": "select source, sum(length(text))::bigint as chars, floor(sum(length(text)) / 50.0)::bigint as rows, sum(length(text)) >= 50000 and floor(sum(length(text)) / 50.0) >= 1000 as enough from documents group by source",
    "detected": """select 'chats' as source, true as already_instruct, 'columns' as format, count(*) as rows from conversations union all select 'benchmark', false, null, count(*) from benchmark
        union all select 'chats twice', true, 'columns', 2 * count(*) from conversations""",
    "lookup_contexts": f"""with c as (select conv_id, turn, case when turn % 3 > 0 then text end as p, case when turn % 2 = 0 and length(trim(text)) > 0 then 'SECTION ' || role || ':' || chr(10) || trim(text) end as b, trim(lower(text)) as whole from conversations
        ), h as (select *, {_HEAD} as head from c), j as (select *, concat_ws(chr(10) || chr(10), head, b) as both_ from h), k as (select *, case when length(both_) > 0 then both_ else whole end as joined, head[1:{LOOKUP // 3}] as start from j)
        select conv_id, turn, case when length(joined) <= {LOOKUP} then joined when head is not null then start || chr(10) || chr(10) || 'DOCUMENT:' || chr(10) || whole[1:{LOOKUP - 20} - length(start)] else joined[1:{LOOKUP}] end as context from k""",
    "reference_blocks": f"""with c as (select *, case when turn % 2 = 0 and length(coalesce(role, '')) > 0 then chr(10) || '[section 2]' || chr(10) || trim(role) end as a,
            case when length(text) > 0 then chr(10) || '[figure 3]' || chr(10) || 'Source: "' || trim(text[1:20]) || '"' end as b from conversations)
        select conv_id, turn, case when (a is null and b is null) or contains(text, {s.q(references.MARKER)}) then text else concat_ws(chr(10), trim(text), '', {s.q(references.MARKER)}, concat_ws(chr(10), a, b)) end as output from c""",
    "document_summaries": f"""with {s.DOCS}, {s.LINES}, {s.SECTIONS}, whole as (select doc_id, (string_agg(text, chr(10) || chr(10) order by section_id))[1:58000] as text from sections where length({s.strip("text")}) > 0 group by doc_id)
        select doc_id, array_to_string(string_split_regex({s.strip("text")}, {s.q(SPLIT)})[1:60], ' ') as summary, null::varchar as error from whole""",
    "task_labels": f"""with {s.DOCS}, t as (select doc_id, {s.strip(f"[{', '.join(map(s.q, VERBS))}][doc_id % {len(VERBS)} + 1] || coalesce({s.sentences('cleaned')}[1], '')[1:60]")} as task from docs
        ), l as (select *, lower(task) as low, regexp_extract_all(lower(task), '[a-z0-9]+') as words from t)
        select doc_id, case when task = '' or (len(words) <= 5 and not {s.like("low", analysis.TASK_VERBS)} and (contains(task, '_') or contains(task, '-') or (task = low and low <> upper(task)))) then task
            {_LADDER} when len(words) > 5 then array_to_string(words[1:4], '_') else task end as label from l""",
}
