"""Fixed vocabularies and patterns, and small Column helpers that agree with Python's string rules where Spark's own do not.

Patterns are free of look-around and of Unicode word boundaries, so that any engine with Java's or RE2's syntax reads them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes for white space.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: What ends a line for Python's splitlines().
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Headings of parts without content.
BAD_HEADINGS = [
    "table of contents", "contents", "list of (?:figures|tables|illustrations|algorithms|abbreviations)", "index", "glossary", "nomenclature", "colophon",
    "references", "bibliography", "works cited", "further reading", "acknowledg(?:e)?ments?", "dedication", "preface", "foreword", "copyright(?: page)?", "license",
    "permissions?", "about the authors?", "about this (?:book|document|guide)", "revision history", "document control", "change log", "version history",
    "approval(?: sheet)?", "candidate information", "submission (?:guidelines?|requirements?|procedures?)", "formatting (?:guidelines?|requirements?|instructions?)",
    "information to all users", "publisher(?:'s)? note",
]
BAD_HEADING = rf"(?i)^(?:#+\s*)?(?:{'|'.join(BAD_HEADINGS)})\s*$"

# Phrases of packaging and legal pages.
CUES = [
    "table of contents", "list of (?:figures|tables|illustrations)", "all rights reserved", r"copyright (?:©|\(c\)|notice)", "creative commons",
    "reproduced (?:with permission|by permission)", "information to all users", "approval sheet", "candidate information", "submission (?:guideline|requirement|procedure)",
    "formatting (?:guideline|requirement|instruction)", "document control", "revision history", "version history", "change log",
    "this (?:work|document|publication) is protected", "no part of this (?:publication|work|document) may be", "printed in the united states", r"\bissn\b", r"\bisbn\b",
]
CUE = rf"(?i)\b(?:{'|'.join(CUES)})\b"

# Lines that carry nothing.
BOILERPLATE = r"(?i)^(?:page\s+\d+(?:\s+of\s+\d+)?|copyright\b[^\n]*|all rights reserved\.?|https?://\S+)$"
TOC_LEADER = r"\.{3,}|…|·{3,}|\s\d{1,4}\s*$"
LAST_NUMBER = r"(?:^|[^\p{L}\p{N}_])\d{1,%d}\s*$"
MARKDOWN_HEADING = r"^#{1,6}\s+[^\n]+"
NAMED_HEADING = r"(?i)^(?:section|chapter|part|article)\s+[A-Z0-9IVXLC.-]+(?:\s*[:—-]\s*[^\n]+)?$"
SECTION_NUMBER = r"^\d+(?:\.\d+)+\s+\S+"
#: Words with inner apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_]+(?:['-]+[\p{L}\p{N}_]+)*"

# Openings of tasks, and words by which answers speak.
TASKS = [
    "prove", "show that", "show", "compute", "find", "solve", "determine", "verify", "evaluate", "calculate", "derive", "demonstrate", "construct", "give an example",
    "explain how", "explain why", "what is", "why does", "true or false", "fill in", "complete the", r"let\s+[^\n]+\s+show",
]
TASK_LINE = rf"(?i)^(?:\(?\d+(?:\.\d+)*\)?[.)]?\s*)?(?:{'|'.join(TASKS)})\b"
NUMBERED_LINE = r"^\(?\d+(?:\.\d+)*\)?[.)]?\s+\S"
ANSWERS = [
    "therefore", "thus", "hence", "because", "since", "implies", "equivalently", "in other words", "is defined as", "means that", "we have", "it follows", "follows that",
    "proof", "solution", "answer", r"result(?:s)? in", "equals", r"denote[sd]?", "consists of", "is called",
]
ANSWER = rf"(?i)\b(?:{'|'.join(ANSWERS)})\b"

# Cross-references to other parts of a book.
ELSEWHERE = [
    r"(?:from|in|see|cf\.?)\s+(?:the\s+)?(?:next|previous|following|preceding|earlier|later)\s+(?:chapter|section|page|paragraph|exercise)", r"as\s+we\s+(?:shall|will)\s+see",
    r"later\s+(?:on\s+)?(?:in\s+)?(?:this|the)\s+(?:chapter|section|book)", r"in\s+the\s+(?:next|previous|following)\s+(?:chapter|section)", r"discussed\s+(?:in|below|above|later)",
    r"see\s+(?:chapter|section|page)\s+\d", r"to\s+be\s+(?:defined|proved|shown|discussed)\s+(?:later|below|in\s+chapter)",
]
CROSS_REFERENCE = rf"(?is)\b(?:{'|'.join(ELSEWHERE)})\b"
FRAGMENT = r"^[a-z(,;:\-]"

# Words that say nothing about what an instruction asks.
STOPWORDS = (
    "a an the and or of to for in on at is are was were be what which who how when where why tell me give help please with from into about that this these those"
    " do does did can could should would"
).split()
TOKEN = r"[a-z0-9][a-z0-9'-]*"
EDGES = " ?.!,;:\"'"

# How an instruction points at a source that its reader does not see.
PROVENANCE = [
    r"\baccording to\b",
    r"\bas (?:described|outlined|stated|noted|mentioned|discussed|presented|reported) in\b",
    r"\bdescribed in (?:the\s+)?(?:\w+\s+){0,4}(?:study|paper|article|thesis|praxis|pipeline|overview|document|source|text)\b",
    r"\bbased on (?:the )?(?:textbook|section|passage|chapter|document|source|text|excerpt|material|study|paper|praxis)\b",
    r"\b(?:the |this |that )?(?:textbook|passage|excerpt|chapter|document|source material)\b",
    r"\b(?:in|from|per) the (?:textbook|section|passage|chapter|document|source|study|paper|article|thesis|praxis)\b",
    r"\b(?:textbook|section|chapter) (?:title|heading)\b",
    r"\bprovided (?:textbook|section|passage|chapter|document|text|excerpt)\b",
    r"\bthe (?:above|following|given|supplied|attached) (?:text|passage|section|excerpt|document)\b",
    r"\brefer(?:ring)? to the (?:text|passage|section|textbook|document|source)\b",
    r"\b(?:the|this|that)\s+(?:study|paper|article|thesis|praxis|dissertation|research)\b",
    r"\bthe authors?\b",
    r"\bin this research\b",
]
CITES_CONTEXT = rf"(?i)(?:{'|'.join(PROVENANCE)})"
STARRED_TITLE = r"\*[^*]{3,80}\*"
VAGUE = (
    r"(?i)\b(?:the|this|that)\s+(?:procedural\s+mechanism|experimental\s+design|proposed\s+(?:system|method|approach|framework|model|pipeline)|methodology|pipeline|framework|approach|"
    r"mechanism|procedure|process|technique|method|system|model|algorithm|evaluation|metric|feedback\s+system)\b"
)
#: After a vague subject: what names it all the same.
NAMED_AFTER = r"\s+(?:of|for|called|known\s+as|named)\s+[A-Za-z0-9]"


def ustrip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def split_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, LINE_END), ustrip), lambda x: F.length(x) > 0)


def letters(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{L}", ""))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))
