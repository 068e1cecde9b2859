"""Lines, sections, paragraphs and sentences of cleaned texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import judge, lex

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
SECTION_TYPE = pa.list_(pa.struct([("section_id", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("paragraphs", pa.list_(pa.string()))]))
SECTION_DDL = "array<struct<section_id: int, title: string, text: string, start: int, end: int, paragraphs: array<string>>>"


def sentences(c: Column) -> Column:
    """Sentences that are not blank."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), lex.ustrip), lambda x: F.length(x) > 0)


def first_sentence(c: Column) -> Column:
    """The first of the sentences of a stripped text, without splitting the rest; null where there is none."""
    return F.nullif(lex.ustrip(F.get(F.split(c, SENTENCE_END, 2), F.lit(0))), F.lit(""))


@dataclass(slots=True)
class Section:
    """A part of a document under a heading; its text is its useful paragraphs."""

    section_id: int
    title: str | None
    text: str
    start: int
    end: int
    paragraphs: list[str]


def sections_of(title: str | None, cleaned: str, hints: judge.Hints | None = None) -> list[Section]:
    """The sections of one document (see sections())."""
    hints = hints or judge.Hints(cleaned)
    parts: list[list] = []  # [named, start of the body, start, lines of the body], by heading
    at = 0
    for line in judge.lines(cleaned):
        stripped = line.strip()
        alone = judge.heading(stripped)
        if alone:
            parts.append([stripped.lstrip("#").strip(), at + len(line) + 1, at, []])
        elif not parts:
            parts.append([None, 0, at, []])
        if not alone and not judge.boilerplate(stripped):
            parts[-1][3].append(line)
        at += len(line) + 1
    chars, first = at - 1, parts[0][0] is None  # sections are numbered by the headings so far
    found = []
    for k, (named, after, _, body) in enumerate(parts):
        own = judge.paragraphs("\n".join(body).strip())
        if own and not judge.bad_heading(named):
            found.append(Section(k + (not first), title if named is None else named, "\n\n".join(own), after, parts[k + 1][2] if k + 1 < len(parts) else chars, own))
    if not found:
        own = judge.paragraphs(cleaned)
        found = [Section(0, title, "\n\n".join(own), 0, chars, own)] if own else []
    good = [x for x in found if not judge.bad_heading(x.title) and not judge.Text(x.text, hints).non_content()]
    return good or found


def by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, sections) of docs (doc_id, title, cleaned): each document's sections side by side, found where its row lies, so that no text is shuffled or sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            found = [[] if text is None else [{n: getattr(s, n) for n in Section.__slots__} for s in sections_of(title, text)] for title, text in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SECTION_TYPE)], ["doc_id", "sections"])

    d = docs.select("doc_id", "title", "cleaned")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, sections {SECTION_DDL}")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_id, title, text, start, end, paragraphs) of docs (doc_id, title, cleaned).

    A heading opens a section; bodies under headings without content go, and lines of boilerplate. A text without a section is one by itself. Sections
    whose text has no content go too, unless that would leave none. Nothing is left of texts without a useful paragraph.
    """
    return by_document(docs).select("doc_id", F.inline("sections"))


def judged_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, heading, bad_heading, boilerplate, prompt_only, high_value) of every line of docs (doc_id, cleaned), stripped; start is the line's offset."""
    names, flags = ("pos", "start"), ("heading", "bad_heading", "boilerplate", "prompt_only", "high_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                hints, start = judge.Hints(text), 0
                for pos, line in enumerate(judge.lines(text)):
                    t = judge.Text(line, hints)
                    rows.append((doc, pos, start, judge.heading(t.v), judge.bad_heading(t.v), judge.boilerplate(t.v), t.prompt_only(), t.high(40)))
                    start += len(line) + 1
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [b.schema.field(0).type, *[pa.int32()] * 2, *[pa.bool_()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", *names, *flags])

    d = docs.select("doc_id", "cleaned")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, {', '.join(f'{n} int' for n in names)}, {', '.join(f'{n} boolean' for n in flags)}")
