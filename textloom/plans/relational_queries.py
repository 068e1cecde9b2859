"""Queries on rows: detection, discovery, capacity, joins, sampling, duplicates, citations, and states of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model_json, structure
from ..operators import capacity, chunk, dedupe, detect, discover, references, sample
from ..operators.prefix import kept
from ..streaming import status
from . import sqltext as s
from .text_queries import docs, load

SEED = 42
PERSONAS = (("line-analyst", "line"), ("summarizer", "section"))


def instructions(spark, sf_dir) -> DataFrame:
    """The first sentence of each document as an instruction."""
    # A row's number keeps the condition above the cleaning, which it would run anew below.
    first = F.struct(structure.first_sentence(F.col("cleaned")).alias("s"), F.monotonically_increasing_id().alias("row"))
    return docs(spark, sf_dir).select("doc_id", first.alias("first")).where("first.s is not null").select("doc_id", F.col("first.s").alias("instruction"))


_INSTRUCTIONS = f"{s.DOCS}, ins as (select doc_id, {s.sentences('cleaned')}[1] as instruction from docs where len({s.sentences('cleaned')}) > 0)"
_NORMAL = f"trim(regexp_replace(replace(lower({s.strip('instruction')}), 'ß', 'ss'), '\\s+', ' ', 'g'), {s.q(dedupe.lex.EDGES)})"
_STOP = "[" + ", ".join(map(s.q, dedupe.lex.STOPWORDS)) + "]"
_KEYS = f"""{_INSTRUCTIONS}, norm as (select *, {_NORMAL} as n from ins
    ), toks as (select *, list_filter(regexp_extract_all(n, {s.q(dedupe.lex.TOKEN)}), lambda t: length(t) > 1 and not list_contains({_STOP}, t)) as t from norm
    ), keyed as (select doc_id, instruction, sha1(n) as exact_key, sha1(array_to_string(list_sort(list_distinct(t))[1:12], ' ')) as near_key,
        case when len(t) > 0 then array_to_string(t[1:5], ' ') else n[1:48] end as stem_key from toks)"""


def instruction_keys(spark, sf_dir):
    return dedupe.with_keys(instructions(spark, sf_dir), "instruction").select("doc_id", "exact_key", "near_key", "stem_key")


def near_first(spark, sf_dir):
    return dedupe.first_of_near(instructions(spark, sf_dir), "instruction", ["doc_id"]).select("doc_id", "near_key")


def claims(spark, sf_dir):
    return dedupe.claimed(instructions(spark, sf_dir), "instruction", ["doc_id"]).select("doc_id", "accepted")


def transcripts(spark, sf_dir):
    return detect.transcripts(load(spark, sf_dir, "conversations"), "conv_id", "role", "text")


def transcript_majority(spark, sf_dir):
    g = transcripts(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if("usable").alias("usable"))
    return g.select("rows", "usable", detect.enough(F.col("usable"), F.col("rows")).alias("already_instruct"))


def column_pairs(spark, sf_dir):
    after = Window.partitionBy("conv_id").orderBy("turn")
    pairs = load(spark, sf_dir, "conversations").withColumn("response", F.lead("text").over(after)).where("role = 'user'")
    usable = detect.said(F.col("text")) & detect.said(F.col("response"))
    g = pairs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(usable).alias("usable"))
    return g.select("rows", "usable", (F.col("usable") / F.col("rows")).alias("ratio"), (detect.enough(F.col("usable"), F.col("rows")) & (F.col("usable") / F.col("rows") >= detect.MAJORITY)).alias("already_instruct"))


def text_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "documents")
    return discover.text_candidates(discover.flat(rows), rows.count())


def id_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "documents")
    return discover.scalar_candidates(discover.flat(rows), rows.count(), discover.ID_NAMES, discover.ID_CHARS)


def row_documents(spark, sf_dir):
    schema = {"text_column": "text", "id_column": "url", "title_column": None, "metadata_columns": ["page_id"]}
    rows = load(spark, sf_dir, "pages").withColumnRenamed("html", "text")
    return discover.documents(rows, schema, "pages").select("doc_id", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.element_at("metadata", "page_id").alias("page_id"))


def nested_text(spark, sf_dir):
    """Chats as nested rows, their distinct texts joined."""
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return rows.select("conv_id", discover.joined_text(discover.values_at(rows, "messages[].text")).alias("text"), F.size(discover.values_at(rows, "messages[].role")).cast("long").alias("turns"))


def _with_metadata(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("int").alias("page_count"))
    return d.withColumn("capacity_chars", F.when(F.col("doc_id") % 10 == 0, F.length("text") * 2))


def corpus_capacity(spark, sf_dir):
    d = _with_metadata(spark, sf_dir)
    chars, pages = capacity.corpus_chars(d), capacity.page_count(d)
    both = chars.withColumn("k", F.lit(1)).join(pages.withColumn("k", F.lit(1)), "k")  # one row each
    return both.select("chars", "pages", capacity.rows_from_chars(F.col("chars"), 4).alias("rows"), capacity.extrapolated(F.lit(100), F.lit(5000), F.col("chars"), 4).alias("extrapolated"), capacity.skim_capacity(F.col("chars"), F.lit(3), F.lit(10)).alias("skimmed"))


def _places(spark, sf_dir, levels: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, level, pool_index, start, end, target_text) of chunks, the last null but for the levels `texts`."""
    return chunk.of_documents(docs(spark, sf_dir), levels, texts=texts).select("doc_id", "level", "pool_index", "start", "end", "target_text")


def _pool(places: DataFrame) -> DataFrame:
    """Line and section chunks as the pools of two personas."""
    persona = F.when(F.col("level") == "line", "line-analyst").when(F.col("level") == "section", "summarizer")
    return places.where("level in ('line', 'section')").select("doc_id", persona.alias("persona"), "pool_index", "start", "end")


def pools_and_anchors(spark, sf_dir, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Line and section chunks as the pools of two personas, and all paragraph chunks as anchors, with their texts if wanted. One pass over the documents finds all of them, and keeps their places."""
    found = kept(_places(spark, sf_dir, ["line", "section", "paragraph"], ("paragraph",) if texts else ()))
    anchors = found.where("level = 'paragraph'").select("doc_id", F.col("pool_index").alias("anchor"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), *([F.col("target_text").alias("a_text")] if texts else []))
    return _pool(found), anchors


def pools(spark, sf_dir) -> DataFrame:
    return kept(_pool(_places(spark, sf_dir, ["line", "section"])))


_POOLS = f"""{s.FULL.replace("with ", "with recursive ", 1)}, {s.CHOSEN_LINES}, {s.LINE_CHUNKS}, {s.PARAGRAPHS}, section_parts as (select * replace (text[1:16000] as text) from candidates
    ), section_chunks as (select doc_id, row_number() over (partition by doc_id order by section_id) - 1 as pool_index, start::integer as start, (start + length(text))::integer as "end"
        from ({s.measured("section_parts", "text")}) where not {s.PROMPT_ONLY} and {s.high_value(160)} qualify pool_index < 5000
    ), pool as (select doc_id, 'line-analyst' as persona, pool_index, start, "end" from line_chunks where pool_index < 5000 union all select doc_id, 'summarizer', pool_index, start, "end" from section_chunks
    ), anchors as (select doc_id, pool_index as anchor, start as a_start, "end" as a_end, target_text as a_text from paragraph_chunks where pool_index < 5000)"""


def levels(spark) -> DataFrame:
    return spark.createDataFrame(list(PERSONAS), "persona string, level string")


def persona_capacity(spark, sf_dir):
    return capacity.pool_capacity(_pool(_places(spark, sf_dir, ["line", "section"])))


def overlap_join(spark, sf_dir):
    pool, anchors = pools_and_anchors(spark, sf_dir)
    return sample.overlapping(pool, anchors).groupBy("doc_id", "anchor", "persona").agg(F.count(F.lit(1)).alias("chunks"), F.min("pool_index").cast("long").alias("first"))


def nearest_join(spark, sf_dir):
    pool, anchors = pools_and_anchors(spark, sf_dir)
    return sample.nearest(pool, anchors).select("doc_id", "anchor", "persona", "pool_index", "start", "end").withColumn("anchor", F.col("anchor").cast("long")).withColumn("pool_index", F.col("pool_index").cast("long"))


def anchor_projection(spark, sf_dir):
    pool, anchors = pools_and_anchors(spark, sf_dir, True)
    p = sample.projected(pool, anchors, levels(spark), SEED)
    return p.select("doc_id", F.col("anchor").cast("long").alias("anchor"), "persona", F.col("pool_index").cast("long").alias("pool_index"), "start", "end", "own_target")


def work_queue(spark, sf_dir):
    w = sample.build_work(pools(spark, sf_dir), 4, SEED)
    return w.select("doc_id", F.col("index").cast("long").alias("index"), "persona", F.col("pool_index").cast("long").alias("pool_index"), F.col("pass").cast("long").alias("pass"), "task_focus")


def work_allocation(spark, sf_dir):
    w = sample.build_work(pools(spark, sf_dir), 4, SEED)
    return sample.allocated(w, 500, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))


def shared_work(spark, sf_dir):
    pool, anchors = pools_and_anchors(spark, sf_dir, True)
    w = sample.build_work(pool, 4, SEED, anchors=anchors, levels=levels(spark))
    return w.select("doc_id", F.col("index").cast("long").alias("index"), "persona", F.col("pool_index").cast("long").alias("pool_index"), "start", "end", F.col("pass").cast("long").alias("pass"), "task_focus", "own_target")


def augmentation(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 17).alias("index"))
    return sample.augmented(w, SEED).select("doc_id", "specificity", "entity_style", "instruction_form")


def analysis_sample(spark, sf_dir):
    return sample.longest_half(load(spark, sf_dir, "documents"), 4, SEED).select("doc_id", F.col("chars").cast("long").alias("chars"))


def page_sample(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 60).cast("int").alias("total"))
    return d.select("doc_id", "total", F.explode(sample.page_sample(F.col("total"), 5, SEED)).alias("page"))


def per_source_sample(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return sample.top_k(d, ["source"], sample.order_key(SEED, "sample", F.col("doc_id")), 3).select("doc_id", "source", F.col("_rank").cast("long").alias("rank"))


def resume(spark, sf_dir):
    """Labels stand for records of finished work."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    records = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Line-Analyst").otherwise("summarizer").alias("persona"))
    personas = spark.createDataFrame([(n,) for n, _ in PERSONAS], "name string")
    return sample.pending(d, personas, records, 2)


def label_coverage(spark, sf_dir):
    return capacity.label_coverage(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def _cited(spark, sf_dir):
    """Chat turns with citations made of their numbers, as the texts have none."""
    c = load(spark, sf_dir, "conversations")
    made = F.concat(
        F.col("text"), F.lit(" See Section "), F.col("turn"), F.lit(".2 and Sec. 4, figures 3; § 12; Theorem A"), F.col("conv_id"), F.lit("(b). Paragraph (a)(ii), sub-paragraph (b), (c)(iv), corollaries 2, Appendices 7, SECTION "), F.col("turn"), F.lit(".2"),
    )
    return c.select("conv_id", "turn", made.alias("text"))


def citations(spark, sf_dir):
    return _cited(spark, sf_dir).select("conv_id", "turn", F.posexplode(references.mentions(F.col("text"))).alias("pos", "m")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "m.kind", "m.label", "m.reference", "m.raw")


def citation_merge(spark, sf_dir):
    found = _cited(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.explode(references.mentions(F.col("text"))).alias("m")).select("id", F.col("m.reference").alias("reference"))
    resolved = found.where(F.col("reference").startswith("section")).select("id", F.upper("reference").alias("reference"), F.lit(True).alias("found"), F.lit("It states a duty.").alias("statement"), F.lit("").alias("excerpt"))
    return references.merged(found, resolved).select("id", "reference", "matched", "reason")


def model_answers(spark, sf_dir):
    """Answers as models give them: fenced, after thoughts, or cut two characters (of the text, not of its escapes) before their text's end; of one character, at its end."""
    c = load(spark, sf_dir, "conversations")
    body, short = (F.to_json(F.struct(text.alias("output"), F.lit(True).alias("standalone"))) for text in (F.col("text"), F.expr("if(length(text) < 2, text, left(text, length(text) - 2))")))
    cut = F.substring(short, F.lit(1), F.length(short) - len('","standalone":true}'))
    noisy = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>so</think>```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 < 2, F.concat(F.lit("Here is the JSON: "), body, F.lit(" done"))).otherwise(cut)
    return c.select("conv_id", "turn", model_json.field(noisy, "output").alias("output"))


def unique_errors(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type = 'error'")
    return status.unique_errors(e.select(F.col("props").alias("message"), "event_id"), "event_id").select("message", "event_id")


def latest_status(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), "value")
    return status.latest(e, "job_id", "at", ["status", "value"])


QUERIES = {
    f.__name__: f
    for f in (
        instruction_keys, near_first, claims, transcripts, transcript_majority, column_pairs, text_columns, id_columns, row_documents, nested_text, corpus_capacity, persona_capacity, overlap_join,
        nearest_join, anchor_projection, work_queue, work_allocation, shared_work, augmentation, analysis_sample, page_sample, per_source_sample, resume, label_coverage, citations, citation_merge,
        model_answers, unique_errors, latest_status,
    )
}

_USER = "list_contains([" + ", ".join(map(s.q, detect.USER_ROLES)) + "], lower(trim(role)))"
_ASSISTANT = "list_contains([" + ", ".join(map(s.q, detect.ASSISTANT_ROLES)) + "], lower(trim(role)))"
_CHATS = f"""select conv_id, count(*) as turns, count(*) >= 2 and coalesce(bool_or(trim(text) <> '' and {_USER}), false) and coalesce(bool_or(trim(text) <> '' and {_ASSISTANT}), false) as usable
    from conversations group by conv_id"""
_CELLS = """cells as (select 'doc_id' as path, 'integer' as kind, doc_id::varchar as value from documents union all select 'text', 'string', text from documents union all select 'lang', 'string', lang from documents
    union all select 'source', 'string', source from documents union all select 'n_chars', 'integer', n_chars::varchar from documents), total as (select count(*) as n from documents)"""
_DRAW = "('0x' || substr({}, {}, 8))::bigint"
_TAKE = "case when full_ then size when pass = 0 then least(size, slots) else least(size, greatest(1, (slots + 1) // 2)) end"
_PLAN = f"""plan as (select doc_id, count(distinct persona) as personas, count(*) as total, greatest(1, ceil(4 / count(distinct persona)))::bigint as slots, 4 >= count(*) as full_ from pool group by doc_id
    ), passes as (select *, unnest(range(0, case when full_ then 3 else 2 end)) as pass from plan
    ), sized as (select p.*, slots, full_, pass, count(*) over (partition by p.doc_id, persona, pass) as size, {s.key(SEED, "'pool'", "p.doc_id", "persona", "pool_index", "pass")} as k from pool p join passes using (doc_id)
    ), taken as (select *, row_number() over (partition by doc_id, persona, pass order by k) as place from sized qualify place <= {_TAKE})"""
_WORK = f"""{_POOLS}, {_PLAN}, focused as (select *, row_number() over (partition by doc_id order by pass, persona, place, pool_index, start) - 1 as cur, {s.key(SEED, "'work'", "doc_id", "persona", "start", '"end"', "pass", "place")} as wk from taken
    ), work as (select doc_id, row_number() over (partition by doc_id order by wk, persona, place) - 1 as index, persona, pool_index, pass, ['explain', 'extract', 'compare'][cur % 3 + 1] as task_focus from focused)"""
_LINES_OF = f"list_transform(string_split_regex({s.strip('a_text')}, {s.LINE_END}), lambda x: {s.strip('x')})"
#: One chunk for each anchor and persona: one that overlaps, else a line of the anchor for lines, else the nearest for sections.
_PROJECTED = f"""ranked as (select a.doc_id, anchor, persona, pool_index, start, "end", a_start, a_text, start < a_end and "end" > a_start as hit,
        row_number() over (partition by a.doc_id, anchor, persona order by not (start < a_end and "end" > a_start),
            case when start < a_end and "end" > a_start then {s.key(SEED, "'overlap'", "a.doc_id", "anchor", "persona", "pool_index")} end, abs(start - a_start), pool_index) as r
        from anchors a join pool p on a.doc_id = p.doc_id
    ), bare as (select doc_id, anchor, persona, a_start, {s.strip("a_text")} as a_text, unnest({_LINES_OF}) as line, generate_subscripts({_LINES_OF}, 1) as pos from ranked where r = 1 and not hit and persona = 'line-analyst'
    ), bare_flags as (select *, {s.high_value(40)} as high, length(line) >= 40 and not {s.PROMPT_ONLY} as fair from ({s.measured("bare", "line", "doc_id, anchor, persona, a_start, a_text, line, pos")})
    ), bare_lines as (select * from (select *, bool_or(high) over (partition by doc_id, anchor, persona) as any_high from bare_flags) where high or (not any_high and fair)
    ), made as (select doc_id, anchor, persona, a_start, a_text, ls[{_DRAW.format(s.key(SEED, "'line'", "doc_id", "anchor", "persona"), 1)} % len(ls) + 1] as own_target
        from (select doc_id, anchor, persona, any_value(a_start) as a_start, any_value(a_text) as a_text, list(line order by pos) as ls from bare_lines group by doc_id, anchor, persona)
    ), projected as (select doc_id, anchor, persona, pool_index, start, "end", null::varchar as own_target from ranked where r = 1 and (hit or persona = 'summarizer')
        union all select doc_id, anchor, persona, null, (a_start + greatest(instr(a_text, own_target) - 1, 0))::integer, (a_start + greatest(instr(a_text, own_target) - 1, 0) + length(own_target))::integer, own_target from made)"""
_CITED = "cited as (select conv_id, turn, text || ' See Section ' || turn || '.2 and Sec. 4, figures 3; § 12; Theorem A' || conv_id || '(b). Paragraph (a)(ii), sub-paragraph (b), (c)(iv), corollaries 2, Appendices 7, SECTION ' || turn || '.2' as text from conversations)"
_KIND = "case when raw[1] = '§' then 'section' else coalesce(map {" + ", ".join(f"{s.q(k)}: {s.q(v)}" for k, v in (references.SHORT | references.PLURALS).items()) + "}[lower(regexp_extract(raw, '^([A-Za-z]+)', 1))], regexp_replace(lower(regexp_extract(raw, '^([A-Za-z]+)', 1)), 's$', '')) end"
_MENTIONS = f"""{_CITED}, raws as (
        select conv_id, turn, 0 as part, unnest(regexp_extract_all(text, {s.q(references.NAMED)})) as raw, generate_subscripts(regexp_extract_all(text, {s.q(references.NAMED)}), 1) as n from cited
        union all select conv_id, turn, 1, unnest(regexp_extract_all(text, {s.q(references.CLAUSE)})), generate_subscripts(regexp_extract_all(text, {s.q(references.CLAUSE)}), 1) from cited
    ), kinds as (select *, case when part = 1 then 'clause' else {_KIND} end as kind,
        case when part = 1 then regexp_extract(raw, '((?:\\([A-Za-z0-9]+\\))+)$', 1) else regexp_extract(raw, {s.q("(" + references.LABEL + "|" + chr(92) + "d+(?:[.:" + chr(92) + "-]" + chr(92) + "d+)*)$")}, 1) end as label from raws
    ), firsts as (select *, kind || ' ' || label as reference, row_number() over (partition by conv_id, turn, lower(kind || ' ' || label) order by part, n) as again from kinds
    ), mentions as (select conv_id, turn, row_number() over (partition by conv_id, turn order by part, n) - 1 as pos, kind, label, reference, raw from firsts where again = 1 qualify pos < 12)"""
_FRONT = "least(greatest(5, total // 10), greatest(0, total - 5))"

ORACLES = {
    "instruction_keys": f"with {_KEYS} select doc_id, exact_key, near_key, stem_key from keyed",
    "near_first": f"with {_KEYS} select min(doc_id) as doc_id, near_key from keyed group by near_key",
    "transcripts": _CHATS,
    "transcript_majority": f"select count(*) as rows, count(*) filter (usable) as usable, count(*) filter (usable) >= greatest(1, floor(count(*) * 0.7)) as already_instruct from ({_CHATS})",
    "column_pairs": """with p as (select role, text, lead(text) over (partition by conv_id order by turn) as response from conversations), u as (
        select count(*) as rows, count(*) filter (trim(coalesce(text, '')) <> '' and trim(coalesce(response, '')) <> '') as usable from p where role = 'user')
        select rows, usable, usable / rows as ratio, usable >= greatest(1, floor(rows * 0.7)) and usable / rows >= 0.7 as already_instruct from u""",
    "text_columns": f"""with {_CELLS}, g as (select path, avg(length(trim(value))) as average, count(*) as k from cells where kind = 'string' and length(trim(value)) > 0 group by path)
        select path, round(case path when 'text' then 12.0 else 0.0 end + least(log10(average + 1) * 2.5, 11.0) + k / n * 4 - case when average < 80 then 8.0 else 0.0 end, 3) as score,
               round(least(k / n, 1.0), 3) as coverage, round_even(average, 0)::bigint as average_chars from g, total""",
    "id_columns": f"""with {_CELLS}, g as (select path, avg(length(value)) as average, count(*) as k, count(distinct value) as kinds from cells where value <> '' group by path having avg(length(value)) <= 300)
        select path, 0.0 + kinds / k * 4 + k / n * 2 as score from g, total""",
    "row_documents": "select trim(url) as doc_id, trim(url) as title, md5(trim(html)) as text_md5, page_id::varchar as page_id from pages where length(trim(html)) > 0",
    "nested_text": """with t as (select conv_id, turn, role, trim(text) as text from conversations), f as (select conv_id, text, min(turn) as turn from t where text <> '' group by conv_id, text)
        select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text, (select count(*) from t where t.conv_id = f.conv_id) as turns from f group by conv_id""",
    "corpus_capacity": """with c as (select sum(length(text) * case when doc_id % 10 = 0 then 2 else 1 end)::bigint as chars from documents)
        select chars, greatest(1, round_even(chars / 1800, 0))::bigint as pages, floor(chars / 50.0)::bigint as rows, greatest(floor(100 * chars / 5000), floor(chars / 50.0), 100)::bigint as extrapolated,
               greatest(chars, floor(chars * (10 / 3)))::bigint as skimmed from c""",
    "persona_capacity": f"{_POOLS} select persona, count(*) as pool_size, count(*) * 3 as capacity from pool group by persona",
    "overlap_join": f"""{_POOLS} select doc_id, anchor::integer as anchor, persona, count(*) as chunks, min(pool_index) as first from anchors join pool using (doc_id) where start < a_end and "end" > a_start group by all""",
    "nearest_join": f"""{_POOLS} select doc_id, anchor, persona, pool_index, start, "end" from anchors join pool using (doc_id) qualify row_number() over (partition by doc_id, anchor, persona order by abs(start - a_start), pool_index) = 1""",
    "anchor_projection": f"{_POOLS}, {_PROJECTED} select doc_id, anchor, persona, pool_index, start, \"end\", own_target from projected",
    "shared_work": f"""{_POOLS}, {_PROJECTED}, {_PLAN}, shared_docs as (select doc_id from plan where personas >= 2 and doc_id in (select doc_id from anchors)
        ), a_sized as (select a.doc_id, anchor, slots, full_, pass, count(*) over (partition by a.doc_id, pass) as size, {s.key(SEED, "'anchor'", "a.doc_id", "anchor", "pass")} as k from anchors a join passes p on a.doc_id = p.doc_id where personas >= 2
        ), a_taken as (select * from a_sized qualify row_number() over (partition by doc_id, pass order by k) <= {_TAKE}
        ), both_ as (select doc_id, persona, pool_index, start, "end", pass, place, null as own_target from taken where doc_id not in (select doc_id from shared_docs)
            union all select p.doc_id, persona, pool_index, start, "end", pass, p.anchor, own_target from projected p join a_taken t on p.doc_id = t.doc_id and p.anchor = t.anchor
        ), focused as (select *, row_number() over (partition by doc_id order by pass, persona, place, pool_index nulls first, start) - 1 as cur, {s.key(SEED, "'work'", "doc_id", "persona", "start", '"end"', "pass", "place")} as wk from both_)
        select doc_id, row_number() over (partition by doc_id order by wk, persona, place) - 1 as index, persona, pool_index, start, "end", pass, ['explain', 'extract', 'compare'][cur % 3 + 1] as task_focus, own_target from focused""",
    "analysis_sample": f"""with r as (select doc_id, coalesce(length(text), 0) as chars, row_number() over (order by coalesce(length(text), 0) desc, doc_id) as n, count(*) over () as total from documents)
        select doc_id, chars from r where n <= greatest(4, total - total // 2) order by {s.key(SEED, "'analysis'", "doc_id")} limit 4""",
    "claims": f"""with recursive {_KEYS}, judged as materialized (select doc_id, near_key, stem_key, {s.strip("instruction")} = '' or {s.like(s.strip("instruction"), dedupe.lex.CITES_CONTEXT)} or {s.like(s.strip("instruction"), dedupe.lex.STARRED_TITLE)} as cites from keyed
        ), rows as materialized (select *, row_number() over (order by doc_id) as n from judged where not cites
        ), fold as (select 0::bigint as n, null::bigint as doc_id, false as accepted, []::varchar[] as nears, []::varchar[] as stems
            union all select q.n, q.doc_id, ok, case when ok then list_append(nears, near_key) else nears end, case when ok then list_append(stems, stem_key) else stems end
            from (select r.n, r.doc_id, near_key, stem_key, nears, stems, not list_contains(nears, near_key) and not (len(stems) >= {dedupe.STEM_FROM} and len(list_filter(stems, lambda x: x = stem_key)) >= {dedupe.STEM_TWICE}
                and (len(list_filter(stems, lambda x: x = stem_key)) + 1) / (len(stems) + 1) > {dedupe.STEM_SHARE}) as ok from fold f join rows r on r.n = f.n + 1) q)
        select doc_id, accepted from fold where n > 0 union all select doc_id, false from judged where cites""",
    "work_queue": f"{_WORK} select * from work",
    "work_allocation": f"""{_WORK}, n as (select doc_id, count(*) as n from work group by doc_id), q as (select doc_id, n, 500 - coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as quota from n)
        select doc_id, least(n, quota)::bigint as rows from q where quota > 0""",
    "augmentation": f"""with k as (select doc_id, doc_id % 17 as index, {s.key(SEED, "'augment'", "doc_id", "doc_id % 17")} as k from documents)
        select doc_id, case when {_DRAW.format("k", 1)} % 100 < 35 then 'preserve exact details' when {_DRAW.format("k", 1)} % 100 < 65 then 'generalize attributes' when {_DRAW.format("k", 1)} % 100 < 85 then 'bound numbers' else 'minimum details' end as specificity,
               [{", ".join(map(s.q, sample.ENTITY_STYLES))}][{_DRAW.format("k", 9)} % 3 + 1] as entity_style, [{", ".join(map(s.q, sample.FORMS))}][index % 10 + 1] as instruction_form from k""",
    "page_sample": f"""with t as (select doc_id, (doc_id % 60)::integer as total from documents), p as (select *, unnest(range(1, total + 1))::integer as page from t
        ), r as (select *, case when page > {_FRONT} and page <= total - least(greatest(2, total // 20), greatest(0, total - {_FRONT} - 5)) then 0 else 1 end as outer_, {s.key(SEED, "'page'", "total", "5", "page")} as k from p)
        select doc_id, total, page from r qualify row_number() over (partition by doc_id order by outer_, k) <= 5""",
    "per_source_sample": f"select doc_id, source, row_number() over (partition by source order by {s.key(SEED, chr(39) + 'sample' + chr(39), 'doc_id')}) as rank from documents qualify rank <= 3",
    "resume": """with r as (select doc_id, case when quality = 1 then 'line-analyst' else 'summarizer' end as persona from labels), p as (select unnest(['line-analyst', 'summarizer']) as name)
        select d.doc_id, name from documents d, p where d.doc_id not in (select doc_id from r group by doc_id having count(*) >= 2) and not exists (select 1 from r where r.doc_id = d.doc_id and r.persona = p.name)""",
    "label_coverage": "select lang, count(*) as documents, count(l.doc_id) as labelled, count(l.doc_id) / count(*) as coverage from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by lang",
    "citations": f"with {_MENTIONS} select conv_id, turn, pos, kind, label, reference, raw from mentions",
    "citation_merge": f"with {_MENTIONS} select conv_id || '-' || turn as id, reference, starts_with(reference, 'section') as matched, case when not starts_with(reference, 'section') then 'omitted by resolver' end as reason from mentions",
    "model_answers": """select conv_id, turn, case when turn % 3 < 2 then text else rtrim(text[1:length(text) - 2]) end as output from conversations""",
    "unique_errors": "select props as message, min(event_id) as event_id from events where event_type = 'error' group by props order by event_id limit 100",
    "latest_status": "select user_id as job_id, arg_max(event_type, (ts, event_id)) as status, arg_max(value, (ts, event_id)) as value from events group by user_id",
}
