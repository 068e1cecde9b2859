"""The gates of gates.py for one text in Python: what is asked of texts inside a document, where sections, lines, paragraphs and sentences depend on each other.

As expressions each of them would be a row of its own with all measures, in shuffles and sorts that carry the texts along; here a document is read once, and a measure is taken only where a gate asks for it.
"""

from __future__ import annotations

import re
import unicodedata

from . import lex

_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())
_DIGITS = frozenset("0123456789")
_LINE_ENDS = frozenset("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ")
# As in expressions and SQL: \b, \d, \s and the folding of case are ASCII's.
_A = re.ASCII
BAD_HEADING, BOILERPLATE, CUE = (re.compile(p, _A) for p in (lex.BAD_HEADING, lex.BOILERPLATE, lex.CUE))
MARKDOWN_HEADING, NAMED_HEADING, NUMBERED_LINE, TASK_LINE = (re.compile(p, _A) for p in (lex.MARKDOWN_HEADING, lex.NAMED_HEADING, lex.NUMBERED_LINE, lex.TASK_LINE))
ANSWER, CROSS_REFERENCE, TOC_LEADER = (re.compile(p, _A) for p in (lex.ANSWER, lex.CROSS_REFERENCE, lex.TOC_LEADER))
NUMBER_FIRST = re.compile(r"^\d{1,3}\s+\S", _A)
# Python has no \p{}: \w of Unicode is [\p{L}\p{N}_].
_LAST_NUMBER = r"(?:^|\W)[0-9]{1,%d}[ \t\n\x0b\f\r]*\Z"
LAST_NUMBER_3, LAST_NUMBER_4 = re.compile(_LAST_NUMBER % 3), re.compile(_LAST_NUMBER % 4)
WORDS = {n: re.compile(r"(?:\W*+\w++(?:['-]++\w++)*+){%d}" % n) for n in (8, 12)}
SENTENCE_END, PARAGRAPH_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])", _A), re.compile(r"\n\s*\n|\n(?=[•*-]\s)", _A)
BLANK_LINES = re.compile(r"\n\s*\n", _A)
# A text without any of these words, in lower case, has no cue of packaging or no reference to another part; every alternative of the pattern has one, within one line.
CUE_WORDS = (
    "contents", "list of", "rights reserved", "copyright", "commons", "reproduced", "to all users", "approval sheet", "candidate", "submission", "formatting", "document control", "revision history",
    "version history", "change log", "is protected", "no part of", "printed in", "issn", "isbn",
)
ELSEWHERE_WORDS = ("chapter", "section", "page", "paragraph", "exercise", "see", "book", "discussed", "later", "below")


class Hints:
    """Whether a document may have cues and references to other parts; all its pieces lean on that."""

    __slots__ = ("cue", "elsewhere")

    def __init__(self, document: str):
        low = document.lower()
        self.cue = any(w in low for w in CUE_WORDS)
        self.elsewhere = any(w in low for w in ELSEWHERE_WORDS)


def lines(text: str) -> list[str]:
    """All lines, as lex.LINE_END cuts them."""
    out = text.splitlines()
    if not text or text[-1] in _LINE_ENDS:
        out.append("")
    return out


def letters(s: str) -> int:
    return len(s) - len(s.encode().translate(None, _LETTERS)) if s.isascii() else sum(map(str.isalpha, s))


def bad_heading(heading: str | None) -> bool:
    value = (heading or "").strip().lstrip("#").strip()
    return 0 < len(value) <= 160 and BAD_HEADING.match(value) is not None


def boilerplate(line: str) -> bool:
    """Of a stripped line."""
    return line[:1] in "pPcCaAhH" and BOILERPLATE.match(line) is not None


def heading(line: str) -> bool:
    """Of a stripped line."""
    if not 0 < len(line) <= 120 or line[-1] in ".?!" or (line[0] in _DIGITS and NUMBER_FIRST.match(line)) or (line[-1] in _DIGITS and LAST_NUMBER_3.search(line)):
        return False
    if (line[0] == "#" and MARKDOWN_HEADING.match(line)) or (line[0] in "sScCpPaA" and NAMED_HEADING.match(line)):
        return True
    n = letters(line)
    if n < 4:
        return False
    upper = sum(map(str.isupper, line)) if line.isascii() else sum(unicodedata.category(c) == "Lu" for c in line)
    return upper / n >= 0.8


def useful(paragraph: str) -> bool:
    """Of a stripped paragraph."""
    return len(paragraph) >= 40 and not boilerplate(paragraph) and WORDS[8].match(paragraph) is not None and letters(paragraph) / len(paragraph) >= 0.45


def raw_paragraphs(text: str) -> list[str]:
    return [p.strip() for p in PARAGRAPH_END.split(text)]


def paragraphs(text: str) -> list[str]:
    return [p for p in raw_paragraphs(text) if useful(p)]


def sentences(text: str) -> list[str]:
    return [x for x in map(str.strip, SENTENCE_END.split(text)) if x]


def _task(line: str) -> bool:
    return line.endswith("?") or TASK_LINE.match(line) is not None


class Text:
    """One text under the gates; each measure is taken once, and only if a gate asks for it."""

    __slots__ = ("_content", "_letters", "_lines", "_prompt", "_prose", "chars", "hints", "v")

    def __init__(self, text: str, hints: Hints):
        self.v = text.strip()
        self.chars, self.hints = len(self.v), hints
        self._lines = self._letters = self._content = self._prompt = self._prose = None

    @property
    def lines(self) -> list[str]:
        if self._lines is None:
            self._lines = [x for x in map(str.strip, self.v.splitlines()) if x]
        return self._lines

    @property
    def letters(self) -> int:
        if self._letters is None:
            self._letters = letters(self.v)
        return self._letters

    def non_content(self) -> bool:
        """gates.is_non_content() without the heading."""
        if self._content is None:
            self._content = self._without_content()
        return self._content

    def _without_content(self) -> bool:
        chars = self.chars
        if chars == 0:
            return True
        cues = len(CUE.findall(self.v[:1200])) if self.hints.cue else 0
        if (chars < 80 and (cues or boilerplate(self.v))) or (cues >= 2 and chars < 4000) or (cues and chars < 600):
            return True
        ls, short = self.lines, 0.0
        n = len(ls)
        if n >= 6:
            short = sum(len(x) <= 60 for x in ls) / n
            if n >= 8 or short >= 0.7:
                leaders = sum(TOC_LEADER.search(x) is not None for x in ls) / n
                if (n >= 8 and leaders >= 0.5) or (short >= 0.7 and (leaders >= 0.35 or sum(len(x) <= 80 and LAST_NUMBER_4.search(x) is not None for x in ls) / n >= 0.45)):
                    return True
        if chars >= 200 and self.letters / chars < 0.40 and (cues or (n >= 8 and short >= 0.65)) and sum(map(str.isdecimal, self.v)) / chars >= 0.28:
            return True
        if cues:
            plain = re.findall("[A-Za-z]{3,}", self.v)
            return len(plain) >= 30 and len({x.lower() for x in plain}) / len(plain) < 0.28
        return False

    def prompt_only(self) -> bool:
        """gates.is_prompt_only()."""
        if self._prompt is None:
            self._prompt = self._only_tasks()
        return self._prompt

    def _only_tasks(self) -> bool:
        ls = self.lines
        n = len(ls)
        if n == 0:
            return True
        tasks = list(map(_task, ls))
        share = sum(tasks) / n
        numbered = sum(NUMBERED_LINE.match(x) is not None and (t or len(x) < 180) for x, t in zip(ls, tasks, strict=True) if x[0] == "(" or x[0] in _DIGITS)
        if share < 0.35 and numbered < 3:
            return False
        answers = len(ANSWER.findall(self.v))
        return (share >= 0.55 and answers <= 1) or (share >= 0.35 and answers == 0 and self.v.count("?") >= 3) or (numbered / n >= 0.5 and numbered >= 3 and answers <= 1)

    def high(self, least: int) -> bool:
        """gates.is_high_value()."""
        if self.chars < least:
            return False
        if self._prose is None:
            self._prose = self._is_prose()
        return self._prose

    def _is_prose(self) -> bool:
        v, chars = self.v, self.chars
        if chars == 0 or "a" <= v[0] <= "z" or v[0] in "(,;:-" or WORDS[12].match(v) is None or self.letters / chars < 0.45:
            return False
        if self.hints.elsewhere:
            rest = CROSS_REFERENCE.sub("", v)
            found = chars - len(rest)
            if found and (chars < 500 or not rest.strip() or found / chars > 0.12):
                return False
        return not self.non_content() and not self.prompt_only()
