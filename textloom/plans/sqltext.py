"""Fragments of DuckDB SQL that say what the gates say, for the queries' oracles."""

from __future__ import annotations

from ..functions import lex


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


SPACE = q(lex.SPACE)
LINE_END = q(lex.LINE_END)


def n(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, {q(pattern)}))"


def like(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {q(pattern)})"


def gone(value: str, pattern: str) -> str:
    return f"regexp_replace({value}, {q(pattern)}, '', 'g')"


def strip(value: str) -> str:
    return f"trim({value}, {SPACE})"


def lines(value: str) -> str:
    return f"list_filter(list_transform(string_split_regex({value}, {LINE_END}), lambda x: {strip('x')}), lambda x: length(x) > 0)"


def squeezed(value: str) -> str:
    a = f"regexp_replace(regexp_replace({value}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace(regexp_replace({a}, '\\n +', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def measured(source: str, text: str, keep: str = "*") -> str:
    """A select with the measures of a text as columns beside `keep`."""
    task = f"(ends_with(x, '?') or {like('x', lex.TASK_LINE)})"
    of = lambda condition: f"len(list_filter(ls, lambda x: {condition}))"
    return f"""select {keep}, length(v) as chars, {like("v", lex.BOILERPLATE)} as boilerplate, {n("v[1:1200]", lex.CUE)} as cues, len(ls) as lines,
        {of("length(x) <= 60")} as short_lines, {of(like("x", lex.TOC_LEADER))} as leader_lines, {of(f"length(x) <= 80 and {like('x', lex.LAST_NUMBER % 4)}")} as page_lines,
        {of(task)} as task_lines, {of(f"{like('x', lex.NUMBERED_LINE)} and ({task} or length(x) < 180)")} as numbered_lines,
        length(v) - length({gone("v", chr(92) + "p{L}")}) as letters, length(v) - length({gone("v", chr(92) + "p{Nd}")}) as digits,
        len(plain) as ascii_words, len(list_distinct(list_transform(plain, lambda x: lower(x)))) as ascii_kinds, {n("v", lex.ANSWER)} as answers,
        length(v) - length(replace(v, '?', '')) as questions, length(v) - length(rest) as reference_chars, length({strip("rest")}) = 0 as only_references,
        {like("v", lex.FRAGMENT)} as fragment, {n("v", lex.WORD)} as words
    from (select *, {lines("v")} as ls, {gone("v", lex.CROSS_REFERENCE)} as rest, regexp_extract_all(v, '[A-Za-z]{{3,}}') as plain
          from (select *, {strip(f"coalesce({text}, '')")} as v from {source}))"""


NON_CONTENT = """coalesce(chars = 0 or (chars < 80 and (boilerplate or cues >= 1)) or (cues >= 2 and chars < 4000) or (cues >= 1 and chars < 600)
    or (lines >= 6 and short_lines / lines >= 0.7 and (leader_lines / lines >= 0.35 or page_lines / lines >= 0.45)) or (lines >= 8 and leader_lines / lines >= 0.5)
    or (chars >= 200 and digits / chars >= 0.28 and letters / chars < 0.40 and (cues >= 1 or (lines >= 8 and short_lines / lines >= 0.65)))
    or (ascii_words >= 30 and cues >= 1 and ascii_kinds / ascii_words < 0.28), false)"""
PROMPT_ONLY = """(lines = 0 or coalesce((task_lines / lines >= 0.55 and answers <= 1) or (questions >= 3 and answers = 0 and task_lines / lines >= 0.35)
    or (numbered_lines / lines >= 0.5 and numbered_lines >= 3 and answers <= 1), false))"""
USEFUL = "coalesce(chars >= 40 and not boilerplate and words >= 8 and letters / chars >= 0.45, false)"


def high_value(least: int) -> str:
    return f"""coalesce(chars >= {least} and not {NON_CONTENT} and not {PROMPT_ONLY} and not (reference_chars > 0 and (chars < 500 or only_references or reference_chars / chars > 0.12))
        and not fragment and words >= 12 and letters / chars >= 0.45, false)"""


def heading(line: str) -> str:
    """Of a stripped line."""
    alphabetic = f"(length({line}) - length({gone(line, chr(92) + 'p{L}')}))"
    upper = f"(length({line}) - length({gone(line, chr(92) + 'p{Lu}')}))"
    rule = f"({like(line, lex.MARKDOWN_HEADING)} or {like(line, lex.NAMED_HEADING)} or ({alphabetic} >= 4 and {upper} / {alphabetic} >= 0.8))"
    digits = "^\\d{1,3}\\s+\\S"
    return f"coalesce(length({line}) between 1 and 120 and not {like(line, '[.?!]$')} and not {like(line, digits)} and not {like(line, lex.LAST_NUMBER % 3)} and {rule}, false)"


def bad_heading(text: str) -> str:
    value = strip(f"ltrim({strip(f'coalesce({text}, {q(chr(32))})')}, '#')")
    return f"(length({value}) between 1 and 160 and {like(value, lex.BAD_HEADING)})"


def boilerplate(line: str) -> str:
    return like(line, lex.BOILERPLATE)


def useful(paragraph: str) -> str:
    alphabetic = f"(length({paragraph}) - length({gone(paragraph, chr(92) + 'p{L}')}))"
    return f"(length({paragraph}) >= 40 and not {boilerplate(paragraph)} and {n(paragraph, lex.WORD)} >= 8 and {alphabetic} / greatest(length({paragraph}), 1) >= 0.45)"


def paragraphs(text: str) -> str:
    """Useful paragraphs; a newline before a bullet is marked first, as RE2 has no look-ahead."""
    marked = f"regexp_replace({text}, '\\n([•*-]\\s)', chr(1) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '\\n\\s*\\n|' || chr(1)), lambda x: {strip('x')}), lambda x: {useful('x')})"


def sentences(text: str) -> str:
    marked = f"regexp_replace({text}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {strip('x')}), lambda x: length(x) > 0)"


def key(seed: int, *parts: str) -> str:
    return f"sha1(concat_ws(':', {', '.join([str(seed), *parts])}))"


DOCS = f"docs as (select doc_id, doc_id::varchar as title, {squeezed('text')} as cleaned from documents)"

#: (doc_id, pos, line, start, stripped, heading, section_id) of every line.
LINES = f"""raw_lines as (
    select doc_id, title, unnest(string_split_regex(cleaned, {LINE_END})) as line, generate_subscripts(string_split_regex(cleaned, {LINE_END}), 1) - 1 as pos from docs
), marked as (
    select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::integer as start, {strip("line")} as stripped from raw_lines
), sectioned as (
    select *, sum(heading::integer) over (partition by doc_id order by pos)::integer as section_id from (select *, {heading("stripped")} as heading from marked)
)"""

#: (doc_id, section_id, title, text, start, end, paragraphs) of every section that stays.
SECTIONS = f"""grouped as (
    select doc_id, section_id, min(title) as doc_title, max(case when heading then {strip("ltrim(stripped, '#')")} end) as named,
           coalesce(min(case when heading then start + length(line) + 1 end), 0) as start, min(start) as first,
           string_agg(line, chr(10) order by pos) filter (not heading and not {boilerplate("stripped")}) as body
    from sectioned group by doc_id, section_id
), found as (
    select doc_id, section_id, coalesce(named, doc_title) as title, start, lead(first) over (partition by doc_id order by section_id) as next, {paragraphs(strip("coalesce(body, '')"))} as paragraphs, named
    from grouped
), own as (
    select f.doc_id, section_id, f.title, start, coalesce(next, length(cleaned)) as "end", paragraphs from found f join docs using (doc_id)
    where len(paragraphs) > 0 and not coalesce({bad_heading("named")}, false)
), every_section as (
    select * from own union all
    select doc_id, 0, title, 0, length(cleaned), paragraphs from (select *, {paragraphs("cleaned")} as paragraphs from docs where doc_id not in (select doc_id from own)) where len(paragraphs) > 0
), judged as (
    {measured('(select *, array_to_string(paragraphs, chr(10) || chr(10)) as text from every_section)', "text")}
), kept as (
    select *, not {bad_heading("title")} and not {NON_CONTENT} as ok from judged
), sections as (
    select doc_id, section_id, title, text, start, "end", paragraphs from (select *, bool_or(ok) over (partition by doc_id) as any_ok from kept) where ok or not any_ok
)"""

CANDIDATES = f"""section_measures as ({measured("sections", "text")}
), section_flags as (
    select *, not {bad_heading("title")} and {high_value(160)} as high, not {bad_heading("title")} and length(text) >= 160 and not {PROMPT_ONLY} and not {NON_CONTENT} as fair from section_measures
), candidates as (
    select doc_id, section_id, title, text, start, "end", paragraphs from (select *, bool_or(high) over (partition by doc_id) as any_high from section_flags) where high or (not any_high and fair)
)"""

#: Chosen lines of candidate sections.
CHOSEN_LINES = f"""line_units as (
    select doc_id, section_id, title, text, start, unnest(list_transform(string_split_regex(text, {LINE_END}), lambda x: {strip("x")})) as line, generate_subscripts(string_split_regex(text, {LINE_END}), 1) - 1 as pos from candidates
), line_flags as (
    select *, {high_value(40)} as high, length(line) >= 40 and not {PROMPT_ONLY} as fair from ({measured("line_units", "line")})
), chosen_lines as (
    select doc_id, section_id, title, text, start, line, pos from (select *, bool_or(high) over (partition by doc_id, section_id) as any_high from line_flags) where high or (not any_high and fair)
)"""

LINE_CHUNKS = """line_chunks as (
    select doc_id, row_number() over (partition by doc_id order by section_id, pos) - 1 as pool_index, title as section_path,
           (string_agg(line, chr(10)) over (partition by doc_id, section_id order by pos rows between 1 preceding and 1 following))[1:1500] as text, line as target_text,
           (start + greatest(instr(text, line) - 1, 0))::integer as start, (start + greatest(instr(text, line) - 1, 0) + length(line))::integer as "end"
    from chosen_lines
)"""

FULL = f"with {DOCS}, {LINES}, {SECTIONS}, {CANDIDATES}"

#: Paragraph chunks: windows grow step by step, by recursion.
PARAGRAPHS = f"""pg_pars as (
    select doc_id, section_id, title, text, start, unnest(paragraphs) as paragraph, generate_subscripts(paragraphs, 1) as par from candidates
), pg_flags as (
    select *, {high_value(80)} as h80, {high_value(60)} as h60, {high_value(40)} as h40, {PROMPT_ONLY} as prompt from ({measured("pg_pars", "paragraph", "doc_id, section_id, title, text, start, paragraph, par")})
), pg_any as (
    select *, bool_or(h80) over (partition by doc_id, section_id) as any80, bool_or(h60) over (partition by doc_id, section_id) as any60 from pg_flags
), pg_around as (
    select doc_id, section_id, list(paragraph order by par) as texts, list(h40 order by par) as highs from pg_any where case when any60 then h60 else not prompt end group by doc_id, section_id
), pg_targets as materialized (
    select p.doc_id, p.section_id, par, paragraph, title, text, start, texts, highs, list_position(texts, paragraph) as spot from pg_any p join pg_around a on p.doc_id = a.doc_id and p.section_id = a.section_id
    where case when any80 then h80 else length(paragraph) >= 80 and not prompt end and list_contains(texts, paragraph)
), pg_grow as (
    select doc_id, section_id, par, 0 as step, paragraph as win, spot - 1 as lo, spot + 1 as hi, false as done from pg_targets
    union all
    select doc_id, section_id, par, step + 1, case when fits then wider else win end, case when on_left then lo - 1 else lo end, case when on_left then hi else hi + 1 end, highs[cand] and not fits
    from (
        select *, highs[cand] and (length(wider) <= 4000 or length(win) < 400) as fits
        from (
            select *, case when on_left then texts[cand] || chr(10) || chr(10) || win else win || chr(10) || chr(10) || texts[cand] end as wider
            from (
                select *, case when on_left then lo else hi end as cand
                from (
                    select g.*, t.texts, t.highs, t.spot, lo >= 1 and (hi > len(t.texts) or t.spot - lo <= hi - t.spot) as on_left
                    from pg_grow g join pg_targets t on g.doc_id = t.doc_id and g.section_id = t.section_id and g.par = t.par
                    where not done and length(win) < 1200 and (lo >= 1 or hi <= len(t.texts))
                )
            )
        )
    )
), pg_windows as (
    select t.doc_id, t.section_id, t.par, title, text, start, paragraph, w.win from pg_targets t
    join (select doc_id, section_id, par, arg_max(win, step)[1:4000] as win from pg_grow group by all) w on t.doc_id = w.doc_id and t.section_id = w.section_id and t.par = w.par
), paragraph_chunks as (
    select doc_id, row_number() over (partition by doc_id order by section_id, par) - 1 as pool_index, title as section_path, win as text, paragraph[1:16000] as target_text,
           (start + greatest(instr(section_text, paragraph) - 1, 0))::integer as start, (start + greatest(instr(section_text, paragraph) - 1, 0) + length(paragraph))::integer as "end"
    from (select * from ({measured("(select *, text as section_text from pg_windows)", "win", "doc_id, section_id, par, title, section_text, start, paragraph, win")}) where not {PROMPT_ONLY} and {high_value(120)})
)"""

#: Page chunks: paragraphs packed into pages, and the pages found one after the other.
PAGES = f"""with recursive {DOCS}, pp_parts as materialized (
    select doc_id, cleaned, list_filter(list_transform(string_split_regex(cleaned, '\\n\\s*\\n'), lambda x: {strip("x")}), lambda x: length(x) > 0) as parts from docs
), pp_pack as (
    select doc_id, 1 as i, 0 as page, parts[1] as text, length(parts[1]) as size from pp_parts where len(parts) > 0
    union all
    select k.doc_id, i + 1, case when size + length(parts[i + 1]) > 2500 then page + 1 else page end, case when size + length(parts[i + 1]) > 2500 then parts[i + 1] else text || chr(10) || chr(10) || parts[i + 1] end,
           case when size + length(parts[i + 1]) > 2500 then length(parts[i + 1]) else size + length(parts[i + 1]) + 2 end
    from pp_pack k join pp_parts p on k.doc_id = p.doc_id where i < len(parts)
), pp_pages as (
    select doc_id, page, arg_max(text, i) as text from pp_pack where doc_id in (select doc_id from docs where not contains(cleaned, chr(12))) group by doc_id, page
    union all
    select doc_id, generate_subscripts(ps, 1) - 1, unnest(ps) from (select doc_id, list_filter(list_transform(string_split(cleaned, chr(12)), lambda x: {strip("x")}), lambda x: length(x) > 0) as ps from docs where contains(cleaned, chr(12)))
), pp_chosen as materialized (
    select doc_id, page, text, row_number() over (partition by doc_id order by page) as k from ({measured("pp_pages", "text", "doc_id, page, text")}) where not {NON_CONTENT} and ({high_value(80)} or (length(text) >= 80 and not {PROMPT_ONLY}))
), pp_placed as (
    select doc_id, 0::bigint as k, 0::bigint as place, 0::bigint as after from docs
    union all
    select q.doc_id, q.k, case when f > 0 then after + f - 1 else after end, case when f > 0 then after + f - 1 else after end + length(q.text)
    from (select c.*, p.after, instr(d.cleaned[p.after + 1:], c.text) as f from pp_placed p join pp_chosen c on p.doc_id = c.doc_id and c.k = p.k + 1 join docs d on d.doc_id = p.doc_id) q
), pp_cut as (
    select c.doc_id, page, text[1:16000] as text, place from pp_chosen c join pp_placed p on c.doc_id = p.doc_id and c.k = p.k
)
select doc_id, row_number() over (partition by doc_id order by page) - 1 as pool_index, 'Page ' || (page + 1) as section_path, text, text as target_text, place::integer as start, (place + length(text))::integer as "end"
from ({measured("pp_cut", "text", "doc_id, page, text, place")}) where not {PROMPT_ONLY} and {high_value(120)} qualify pool_index < 5000"""
