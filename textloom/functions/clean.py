"""Text cleaning: tags, entities, pages, blanks and hard wraps, through one Arrow function."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lex

#: A tag that makes a text HTML.
TAGS = r"<(?:html|body|p|div|h[1-6]|br|table)\b"
#: Elements whose text goes.
DROPPED = ("script", "style", "nav", "footer")
#: A text is hard-wrapped from so many lines, below so many characters a line, from such a share of blank lines.
WRAP_LINES, WRAP_CHARS, WRAP_BLANK = 4, 65, 0.3
#: Characters from which a rebuilt paragraph may end.
PARAGRAPH = 200


class _Text(HTMLParser):
    """Text nodes outside the dropped elements. Nesting is counted for each dropped name by itself, as other tags are often unbalanced."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside = dict.fromkeys(DROPPED, 0)

    def handle_starttag(self, tag, attrs):
        if tag in self.inside:
            self.inside[tag] += 1

    def handle_endtag(self, tag):
        if self.inside.get(tag):
            self.inside[tag] -= 1

    def handle_data(self, data):
        if not any(self.inside.values()):
            self.parts.append(data)


def html_to_text(markup: str) -> str:
    """Text nodes joined by newlines; the title stays."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.parts)


def squeeze(text: str) -> str:
    """Runs of blanks as one, none at a line's start, one blank line at most. Most texts have nothing to squeeze, which a search for fixed strings tells soonest."""
    if "\t" in text or "  " in text:
        text = re.sub(r"[ \t]+", " ", text)
    if "\n " in text:
        text = re.sub(r"\n[ \t]+", "\n", text)
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    return text.strip()


def heading_like(line: str) -> bool:
    """is_heading() of the gates for one stripped line."""
    if not line or len(line) > 120 or line[-1] in ".?!" or re.match(r"\d{1,3}\s+\S", line) or re.search(r"\b\d{1,3}$", line):
        return False
    if re.match(lex.MARKDOWN_HEADING, line) or re.match(lex.NAMED_HEADING, line):
        return True
    alphabetic = [c for c in line if c.isalpha()]
    return len(alphabetic) >= 4 and sum(map(str.isupper, alphabetic)) >= 0.8 * len(alphabetic)


def reflow(text: str) -> str:
    """Paragraphs of a text that was wrapped line by line; other texts as they are."""
    every = [x.strip() for x in text.splitlines()]
    lines = [x for x in every if x]
    wrapped = len(lines) >= WRAP_LINES and sum(map(len, lines)) / len(lines) < WRAP_CHARS and (len(every) - len(lines)) / len(every) >= WRAP_BLANK
    if not wrapped:
        return squeeze(text) if lines else ""
    blocks: list[list[str]] = []
    closed = True  # whether the last block takes no more lines
    for line in lines:
        alone = heading_like(line) or re.match(lex.BOILERPLATE, line) is not None
        last = blocks[-1] if blocks else []
        full = len(" ".join(last)) >= PARAGRAPH and last[-1][-1] in ".!?:;" and (line[0].isupper() or line[0].isdigit())
        if alone or closed or full or re.match(lex.SECTION_NUMBER, line):
            blocks.append([line])
        else:
            last.append(line)
        closed = alone
    return "\n\n".join(" ".join(b) for b in blocks)


def clean_text(text: str | None, page_ok=None) -> str:
    """One text, all steps. page_ok judges each page of a text with page breaks; without it all pages with text stay."""
    text = text or ""
    if "\f" in text:
        pages = [clean_text(p) for p in text.split("\f")]
        return "\f".join(p for p in pages if p and (page_ok is None or page_ok(p)))
    if "<" in text and re.search(TAGS, text, re.IGNORECASE):
        text = html_to_text(text)
    text = html.unescape(text).replace("\r\n", "\n").replace("\r", "\n")
    return reflow(squeeze(text))


def squeezed(c: Column) -> Column:
    """squeeze() as an expression."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return lex.ustrip(F.regexp_replace(F.regexp_replace(c, "\n +", "\n"), "\n{3,}", "\n\n"))


@F.arrow_udf(T.StringType())
def clean_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else clean_text(x) for x in texts.to_pylist()], pa.string())


def cleaned(df: DataFrame, text: str, out: str = "cleaned") -> DataFrame:
    """df with the cleaned text; an empty one of null. All texts go through Python, in Arrow batches: to tell by expressions which of them need it took longer than to clean them.

    Pages of a text are judged afterwards, by drop_pages(), as the gates are column expressions.
    """
    return df.withColumn(out, clean_udf(F.coalesce(F.col(text), F.lit(""))))


def drop_pages(df: DataFrame, text: str) -> DataFrame:
    """df without the pages of a text with page breaks that the gates find without content. Each row's pages stay its own, whatever other rows are called; a text without a page left is empty."""
    from . import gates

    others = [c for c in df.columns if c != text]
    paged = df.where(F.col(text).contains("\f")).select(F.struct(*others).alias("row"), F.monotonically_increasing_id().alias("number"), text)
    paged = paged.select("row", "number", F.posexplode(F.split(text, "\f")).alias("n", "page"))  # apart, as rows are numbered before they fall into pages
    judged = gates.measured(paged, "page").withColumn("good", F.when(~gates.is_non_content(F.col("m")), F.struct("n", "page")))
    joined = judged.groupBy("number").agg(F.first("row").alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list("good")), lambda x: x["page"]), "\f").alias("kept"))
    out = joined.select("row.*", F.col("kept").alias(text)).select(df.columns)
    return df.where(~F.coalesce(F.col(text).contains("\f"), F.lit(False))).unionByName(out)


def slug(c: Column) -> Column:
    """Lower-case, runs of other signs as one hyphen; 'persona' where nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("persona"))


def token_estimate(c: Column) -> Column:
    """A token for every four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def normalized_lines(c: Column) -> Column:
    """Stripped lines that are not blank, a blank line between them."""
    return F.array_join(lex.split_lines(c), "\n\n")


def excerpt(c: Column, chars: int = 700) -> Column:
    """The beginning of a text with white space collapsed."""
    return F.substring(F.regexp_replace(lex.ustrip(c), rf"(?U)\s+", " "), 1, chars)


def truncated(c: Column, limit: int = 0) -> Column:
    """A text cut to a limit; 0 is none."""
    return c if limit <= 0 else F.substring(c, 1, limit)
