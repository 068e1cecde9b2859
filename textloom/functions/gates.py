"""Quality gates on texts, as boolean Columns over one struct of measures, so that each pattern runs once a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lex


def _share(part: Column, whole: Column) -> Column:
    """Null of nothing, also where division by zero is an error."""
    return F.try_divide(part, whole)


def is_bad_heading(heading: Column) -> Column:
    """Table of contents, references, preface and the like."""
    value = lex.ustrip(F.ltrim(lex.ustrip(F.coalesce(heading, F.lit(""))), F.lit("#")))
    return (F.length(value) > 0) & (F.length(value) <= 160) & value.rlike(lex.BAD_HEADING)


def is_boilerplate(line: Column) -> Column:
    return line.rlike(lex.BOILERPLATE)


def is_heading(line: Column) -> Column:
    """Of a stripped line: markdown, named or upper-case headings; running headers with page numbers are none."""
    n = lex.letters(line)
    upper = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    plain = (F.length(line) > 0) & (F.length(line) <= 120) & ~line.rlike(r"[.?!]$") & ~line.rlike(r"^\d{1,3}\s+\S") & ~line.rlike(lex.LAST_NUMBER % 3)
    return plain & (line.rlike(lex.MARKDOWN_HEADING) | line.rlike(lex.NAMED_HEADING) | ((n >= 4) & (_share(upper, n) >= 0.8)))


def _of_lines(condition) -> Column:
    return F.size(F.filter("_lines", condition))


def measured(df: DataFrame, text: str, out: str = "m") -> DataFrame:
    """df with a struct of what the gates ask about a text: lengths, shares and counts of its stripped value."""
    df = df.withColumn("_value", lex.ustrip(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_lines", lex.split_lines(F.col("_value"))).withColumn("_rest", F.regexp_replace("_value", lex.CROSS_REFERENCE, "")).withColumn("_ascii", F.regexp_extract_all("_value", F.lit("[A-Za-z]{3,}"), 0))
    v = F.col("_value")
    task = lambda x: x.endswith("?") | x.rlike(lex.TASK_LINE)
    fields = {
        "chars": F.length(v),
        "boilerplate": is_boilerplate(v),
        "cues": lex.count(F.substring(v, 1, 1200), lex.CUE),
        "lines": F.size("_lines"),
        "short_lines": _of_lines(lambda x: F.length(x) <= 60),
        "leader_lines": _of_lines(lambda x: x.rlike(lex.TOC_LEADER)),
        "page_lines": _of_lines(lambda x: (F.length(x) <= 80) & x.rlike(lex.LAST_NUMBER % 4)),
        "task_lines": _of_lines(task),
        "numbered_lines": _of_lines(lambda x: x.rlike(lex.NUMBERED_LINE) & (task(x) | (F.length(x) < 180))),
        "letters": lex.letters(v),
        "digits": F.length(v) - F.length(F.regexp_replace(v, r"\p{Nd}", "")),
        "ascii_words": F.size("_ascii"),
        "ascii_kinds": F.size(F.array_distinct(F.transform("_ascii", F.lower))),
        "answers": lex.count(v, lex.ANSWER),
        "questions": F.length(v) - F.length(F.replace(v, F.lit("?"), F.lit(""))),
        "reference_chars": F.length(v) - F.length("_rest"),
        "only_references": F.length(lex.ustrip(F.col("_rest"))) == 0,
        "fragment": v.rlike(lex.FRAGMENT),
        "words": lex.count(v, lex.WORD),
        # A row's number keeps conditions on the measures above them: pushed below, each mention would run its patterns anew.
        "row": F.monotonically_increasing_id(),
    }
    return df.withColumn(out, F.struct(*[c.alias(n) for n, c in fields.items()])).drop("_value", "_lines", "_rest", "_ascii")


def is_non_content(m: Column, bad_heading: Column | None = None) -> Column:
    """Contents pages, legal and packaging texts, page lists, by structure and density of cues."""
    n, chars, cues = m["lines"], m["chars"], m["cues"]
    out = (chars == 0) | ((chars < 80) & (m["boilerplate"] | (cues >= 1))) | ((cues >= 2) & (chars < 4000)) | ((cues >= 1) & (chars < 600))
    out |= (n >= 6) & (_share(m["short_lines"], n) >= 0.7) & ((_share(m["leader_lines"], n) >= 0.35) | (_share(m["page_lines"], n) >= 0.45))
    out |= (n >= 8) & (_share(m["leader_lines"], n) >= 0.5)
    out |= (chars >= 200) & (_share(m["digits"], chars) >= 0.28) & (_share(m["letters"], chars) < 0.40) & ((cues >= 1) | ((n >= 8) & (_share(m["short_lines"], n) >= 0.65)))
    out |= (m["ascii_words"] >= 30) & (cues >= 1) & (_share(m["ascii_kinds"], m["ascii_words"]) < 0.28)
    out = F.coalesce(out, F.lit(False))
    return out if bad_heading is None else out | bad_heading


def is_prompt_only(m: Column) -> Column:
    """Mostly tasks or questions, with hardly an answer."""
    n = m["lines"]
    out = ((_share(m["task_lines"], n) >= 0.55) & (m["answers"] <= 1)) | ((m["questions"] >= 3) & (m["answers"] == 0) & (_share(m["task_lines"], n) >= 0.35))
    out |= (_share(m["numbered_lines"], n) >= 0.5) & (m["numbered_lines"] >= 3) & (m["answers"] <= 1)
    return (n == 0) | F.coalesce(out, F.lit(False))


def is_high_value(m: Column, least: int = 80) -> Column:
    """Prose that an instruction may rest on."""
    elsewhere = (m["reference_chars"] > 0) & ((m["chars"] < 500) | m["only_references"] | (_share(m["reference_chars"], m["chars"]) > 0.12))
    return F.coalesce((m["chars"] >= least) & ~is_non_content(m) & ~is_prompt_only(m) & ~elsewhere & ~m["fragment"] & (m["words"] >= 12) & (_share(m["letters"], m["chars"]) >= 0.45), F.lit(False))


def is_useful(m: Column) -> Column:
    """A paragraph worth keeping in a section."""
    return F.coalesce((m["chars"] >= 40) & ~m["boilerplate"] & (m["words"] >= 8) & (_share(m["letters"], m["chars"]) >= 0.45), F.lit(False))


def cites_context(text: Column) -> Column:
    """Whether an instruction depends on a source that its reader does not see; so do empty ones."""
    v = lex.ustrip(F.coalesce(text, F.lit("")))
    return (F.length(v) == 0) | v.rlike(lex.CITES_CONTEXT) | v.rlike(lex.STARRED_TITLE)


def containment_failure(instruction: Column, output: Column) -> Column:
    """Why a pair is not understandable by itself, or null."""
    i, o = (lex.ustrip(F.coalesce(c, F.lit(""))) for c in (instruction, output))
    # A subject that is named after all is taken out first, as a pattern without look-ahead cannot tell.
    named = F.regexp_replace(F.concat(i, F.lit("\n"), o), lex.VAGUE + lex.NAMED_AFTER, " ")
    return (
        F.when((F.length(i) == 0) | (F.length(o) == 0), "the instruction or the output is empty")
        .when(cites_context(i) | o.rlike(lex.CITES_CONTEXT), "the pair points at a source that a reader does not see")
        .when(named.rlike(lex.VAGUE), "the pair has a subject without a name")
    )


def valid_pair(instruction: Column, output: Column, standalone: Column) -> Column:
    """At least 8 and 2 characters, a stated flag, and the flag set."""
    return F.coalesce((F.length(lex.ustrip(instruction)) >= 8) & (F.length(lex.ustrip(output)) >= 2) & standalone, F.lit(False))


def enough_source(chars: Column, rows: Column) -> Column:
    """Whether a source is large enough for a job."""
    return (chars >= 50_000) & (rows >= 1_000)
