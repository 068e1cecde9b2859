"""Queries on texts: cleaning, gates, structure and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, gates, lex, structure
from ..operators import chunk
from . import sqltext as s


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, cleaned) of all documents."""
    return clean.cleaned(load(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), "text"), "text").drop("text")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(docs(spark, sf_dir))


def text_clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"), F.length("cleaned").alias("chars"))


def html_text(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    return clean.cleaned(pages, "html", "text").select("page_id", "text", F.length("text").alias("chars"), clean.token_estimate(F.col("text")).alias("tokens"))


def document_gates(spark, sf_dir):
    m = F.col("m")
    return gates.measured(load(spark, sf_dir, "documents").select("doc_id", "text"), "text").select(
        "doc_id", *[m[c].cast("long").alias(c) for c in ("chars", "cues", "lines", "letters", "digits", "words", "answers")],
        gates.is_non_content(m).alias("non_content"), gates.is_prompt_only(m).alias("prompt_only"), gates.is_high_value(m).alias("high_value"), gates.is_useful(m).alias("useful"),
    )


def line_gates(spark, sf_dir):
    return structure.judged_lines(docs(spark, sf_dir))


def section_parse(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "section_id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "start", "end", F.size("paragraphs").cast("long").alias("paragraphs"))


def sentence_split(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(structure.sentences(F.col("cleaned"))).alias("pos", "sentence"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def text_scalars(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", clean.slug(F.concat_ws(" ", "source", "lang", F.lit("Über_x"))).alias("slug"), clean.token_estimate(F.col("text")).cast("long").alias("tokens"), clean.excerpt(F.col("text")).alias("excerpt"), clean.truncated(F.col("text"), 100).alias("head"), F.md5(clean.normalized_lines(F.col("text")).cast("binary")).alias("lines_md5"))


def _chunk_columns(df):
    return df.select("doc_id", F.col("pool_index").cast("long").alias("pool_index"), "section_path", "text", "target_text", "start", "end")


def chunks_document(spark, sf_dir):
    return _chunk_columns(chunk.document_chunks(docs(spark, sf_dir)))


def chunks_page(spark, sf_dir):
    return _chunk_columns(chunk.page_chunks(docs(spark, sf_dir)))


def chunks_section(spark, sf_dir):
    return _chunk_columns(chunk.of_documents(docs(spark, sf_dir), ["section"]))


def chunks_line(spark, sf_dir):
    return _chunk_columns(chunk.of_documents(docs(spark, sf_dir), ["line"]))


def chunks_needle(spark, sf_dir):
    return _chunk_columns(chunk.of_documents(docs(spark, sf_dir), ["needle"]))


def chunks_paragraph(spark, sf_dir):
    return _chunk_columns(chunk.of_documents(docs(spark, sf_dir), ["paragraph"]))


def pair_gates(spark, sf_dir):
    """Questions and answers of chats as pairs."""
    from pyspark.sql import Window

    c = load(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    return c.select("conv_id", "turn", gates.cites_context(F.col("text")).alias("cites"), gates.containment_failure(F.col("text"), F.col("answer")).alias("failure"), gates.valid_pair(F.col("text"), F.coalesce("answer", F.lit("")), F.lit(True)).alias("valid"))


QUERIES = {
    "text_clean": text_clean, "html_text": html_text, "document_gates": document_gates, "line_gates": line_gates, "section_parse": section_parse, "sentence_split": sentence_split,
    "text_scalars": text_scalars, "chunks_document": chunks_document, "chunks_page": chunks_page, "chunks_section": chunks_section, "chunks_line": chunks_line,
    "chunks_needle": chunks_needle, "chunks_paragraph": chunks_paragraph, "pair_gates": pair_gates,
}

_AFTER = s.like("value", lex.CITES_CONTEXT)
ORACLES = {
    "text_clean": f"with {s.DOCS} select doc_id, md5(cleaned) as cleaned_md5, length(cleaned)::integer as chars from docs",
    "document_gates": f"""select doc_id, chars::bigint as chars, cues::bigint as cues, lines::bigint as lines, letters::bigint as letters, digits::bigint as digits, words::bigint as words, answers::bigint as answers,
        {s.NON_CONTENT} as non_content, {s.PROMPT_ONLY} as prompt_only, {s.high_value(80)} as high_value, {s.USEFUL} as useful from ({s.measured("documents", "text", "doc_id")})""",
    "line_gates": f"""with {s.DOCS}, {s.LINES} select doc_id, pos::integer as pos, start, heading, {s.bad_heading("stripped")} as bad_heading, {s.boilerplate("stripped")} as boilerplate, {s.PROMPT_ONLY} as prompt_only,
        {s.high_value(40)} as high_value from ({s.measured("sectioned", "stripped", "doc_id, pos, start, heading, stripped")})""",
    "section_parse": f"""with {s.DOCS}, {s.LINES}, {s.SECTIONS} select doc_id, section_id, title, md5(text) as text_md5, start::integer as start, "end"::integer as "end", len(paragraphs) as paragraphs from sections""",
    "sentence_split": f"with {s.DOCS} select doc_id, generate_subscripts({s.sentences('cleaned')}, 1) - 1 as pos, unnest({s.sentences('cleaned')}) as sentence from docs",
    "text_scalars": f"""select doc_id, trim(regexp_replace(lower(concat_ws(' ', source, lang, 'Über_x')), '[^a-z0-9]+', '-', 'g'), '-') as slug, greatest(1, length(text) // 4)::bigint as tokens,
        (regexp_replace({s.strip("text")}, '\\s+', ' ', 'g'))[1:700] as excerpt, text[1:100] as head, md5(array_to_string({s.lines("text")}, chr(10) || chr(10))) as lines_md5 from documents""",
    "chunks_document": f"""with {s.DOCS}, parts as (select doc_id, title, cleaned[1:16000] as text from docs)
        select doc_id, 0::bigint as pool_index, title as section_path, text, text as target_text, 0 as start, length(text)::integer as "end" from ({s.measured("parts", "text")}) where {s.high_value(160)}""",
    "chunks_section": f"""{s.FULL}, parts as (select * replace (text[1:16000] as text) from candidates)
        select doc_id, row_number() over (partition by doc_id order by section_id) - 1 as pool_index, title as section_path, text, text as target_text, start::integer as start, (start + length(text))::integer as "end"
        from ({s.measured("parts", "text")}) where not {s.PROMPT_ONLY} and {s.high_value(160)} qualify pool_index < 5000""",
    "chunks_line": f"{s.FULL}, {s.CHOSEN_LINES}, {s.LINE_CHUNKS} select * from line_chunks where pool_index < 5000",
    "chunks_page": s.PAGES,
    "chunks_paragraph": f"{s.FULL.replace('with ', 'with recursive ', 1)}, {s.PARAGRAPHS} select * from paragraph_chunks where pool_index < 5000",
    "chunks_needle": f"""{s.FULL}, pars as (
            select doc_id, section_id, title, text, start, unnest(paragraphs) as paragraph, generate_subscripts(paragraphs, 1) as par from candidates
        ), par_flags as (select *, {s.high_value(80)} as high, length(paragraph) >= 80 and not {s.PROMPT_ONLY} as fair from ({s.measured("pars", "paragraph", "doc_id, section_id, title, text, start, paragraph, par")})
        ), chosen as (select * from (select *, bool_or(high) over (partition by doc_id, section_id) as any_high from par_flags) where high or (not any_high and fair)
        ), sents as (select doc_id, section_id, title, text, start, paragraph, par, unnest({s.sentences("paragraph")}) as sentence, generate_subscripts({s.sentences("paragraph")}, 1) as pos from chosen
        ), sent_flags as (select *, {s.high_value(40)} as high from ({s.measured("sents", "sentence", "doc_id, section_id, title, text, start, paragraph, par, sentence, pos")})
        ), targets as (select *, bool_or(high) over (partition by doc_id, section_id, par) as any_high from sent_flags
        ), hits as (select *, start + greatest(instr(text, paragraph) - 1, 0) as place from targets where high or (not any_high and pos = 1))
        select doc_id, row_number() over (partition by doc_id order by section_id, par, pos) - 1 as pool_index, title as section_path, text[1:16000] as text, case when any_high then sentence else paragraph end as target_text,
               place::integer as start, (place + length(paragraph))::integer as "end" from hits qualify pool_index < 5000""",
    "pair_gates": f"""with pairs as (
            select conv_id, turn, role, {s.strip("coalesce(text, '')")} as i, {s.strip("coalesce(lead(text) over (partition by conv_id order by turn), '')")} as o from conversations
        ), judged as (select *, i = '' or {s.like("i", lex.CITES_CONTEXT)} or {s.like("i", lex.STARRED_TITLE)} as cites,
               regexp_replace(i || chr(10) || o, {s.q(lex.VAGUE + lex.NAMED_AFTER)}, ' ', 'g') as named from pairs where role = 'user')
        select conv_id, turn, cites, case when i = '' or o = '' then 'the instruction or the output is empty' when cites or {s.like("o", lex.CITES_CONTEXT)} then 'the pair points at a source that a reader does not see'
            when {s.like("named", lex.VAGUE)} then 'the pair has a subject without a name' end as failure, length(i) >= 8 and length(o) >= 2 as valid from judged""",
}
