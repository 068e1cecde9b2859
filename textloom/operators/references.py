"""Citations in texts: extraction, merging with what a resolver found, and the block appended to an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 12
LABEL = r"[A-Z]?\d+(?:[.:\-]\d+)*(?:\([a-z0-9]+\))?[A-Za-z]?"
# Units that are cited, by their names in full and abbreviated.
UNITS = "articles? sections? chapters? clauses? regulations? schedules? paragraphs? appendices appendix parts? figures? tables? theorems? lemmas? propositions? corollaries? equations? definitions? examples? exercises? rules? provisions?".split()
SHORT = {"art": "article", "sec": "section", "ch": "chapter", "reg": "regulation", "para": "paragraph", "fig": "figure", "eq": "equation"}
#: Plurals that do not end in s alone; the text's own plural "corollaries" is the only form of its unit that is found.
PLURALS = {"appendices": "appendix", "corollaries": "corollary"}
NAMED = rf"(?i)\b(?:{'|'.join(UNITS)})\s+{LABEL}\b|\b(?:{'|'.join(s + chr(92) + '.' for s in SHORT)})\s*{LABEL}\b|§\s*\d+(?:[.:\-]\d+)*\b"
CLAUSE = r"(?i)(?:sub-)?paragraphs?\s+\([a-z0-9]+\)(?:\((?:[ivx]{1,4}|\d+)\))?|\([a-z]\)\((?:[ivx]{1,4}|\d+)\)"
MARKER = "What the referenced material states:"
LOOKUP = 28_000


def _kind(raw: Column) -> Column:
    """The unit of a citation by its singular name."""
    word = F.lower(F.regexp_extract(raw, r"^([A-Za-z]+)", 1))
    table = F.create_map(*[F.lit(x) for pair in (SHORT | PLURALS).items() for x in pair])
    return F.when(F.substring(raw, 1, 1) == "§", "section").otherwise(F.coalesce(F.element_at(table, word), F.regexp_replace(word, "s$", "")))


def mentions(text: Column) -> Column:
    """array<struct<kind, label, reference, raw>>: named units first, then clause labels; each reference once (by lower case), LIMIT at most."""
    text = F.coalesce(text, F.lit(""))
    named = F.transform(
        F.regexp_extract_all(text, F.lit(NAMED), 0),
        lambda raw: F.struct(_kind(raw).alias("kind"), F.regexp_extract(raw, rf"({LABEL}|\d+(?:[.:\-]\d+)*)$", 1).alias("label"), raw.alias("raw")),
    )
    clauses = F.transform(
        F.regexp_extract_all(text, F.lit(CLAUSE), 0),
        lambda raw: F.struct(F.lit("clause").alias("kind"), F.regexp_extract(raw, r"((?:\([A-Za-z0-9]+\))+)$", 1).alias("label"), raw.alias("raw")),
    )
    every = F.transform(F.concat(named, clauses), lambda m: F.struct(m["kind"].alias("kind"), m["label"].alias("label"), F.concat(m["kind"], F.lit(" "), m["label"]).alias("reference"), m["raw"].alias("raw")))
    keys = F.transform(every, lambda m: F.lower(m["reference"]))
    return F.slice(F.filter(every, lambda m, i: F.array_position(keys, F.lower(m["reference"])) == i + 1), 1, LIMIT)


def merged(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions (id, reference) against a resolver's findings (id, reference, found, statement, excerpt), by reference without case.

    A mention that the resolver left out stays, unmatched, with a reason; findings beyond the mentions stay too.
    """
    a = found.select("id", F.col("reference").alias("_mention"), F.lower("reference").alias("_key"))
    b = resolved.withColumn("_key", F.lower("reference"))
    has = lambda c: F.length(F.coalesce(F.trim(c), F.lit(""))) > 0
    out = a.join(b, ["id", "_key"], "full_outer")
    matched = F.coalesce(F.col("found") & (has("statement") | has("excerpt")), F.lit(False))
    reason = F.when(F.col("reference").isNull(), "omitted by resolver")
    return out.select("id", F.coalesce("_mention", "reference").alias("reference"), "statement", "excerpt", matched.alias("matched"), reason.alias("reason"))


def with_block(output: Column, findings: Column) -> Column:
    """An answer with its matched findings (array<struct<reference, statement, excerpt, matched>>) appended; once only."""
    said = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0
    matched = F.filter(findings, lambda f: f["matched"] & (said(f["statement"]) | said(f["excerpt"])))
    block = F.transform(
        matched,
        lambda f: F.concat_ws(
            "\n", F.lit(""), F.concat(F.lit("["), f["reference"], F.lit("]")), F.when(said(f["statement"]), F.trim(f["statement"])),
            F.when(said(f["excerpt"]), F.concat(F.lit('Source: "'), F.trim(f["excerpt"]), F.lit('"'))),
        ),
    )
    text = F.concat_ws("\n", F.trim(output), F.lit(""), F.lit(MARKER), F.array_join(block, "\n"))
    return F.when((F.size(matched) == 0) | output.contains(MARKER), output).otherwise(text)


def lookup_context(passage: Column, sections: Column, cleaned: Column, limit: int = LOOKUP) -> Column:
    """What a resolver reads: the passage and the sections (array<struct<title, text>>); beyond the limit a third for the passage, and the text's beginning."""
    own = F.trim(F.coalesce(passage, F.lit("")))
    head = F.when(F.length(own) > 0, F.concat(F.lit("SAMPLED PASSAGE:\n"), own))
    bodies = F.transform(F.filter(sections, lambda s: F.length(F.trim(s["text"])) > 0), lambda s: F.concat(F.lit("SECTION "), s["title"], F.lit(":\n"), F.trim(s["text"])))
    joined = F.concat_ws("\n\n", head, F.when(F.size(bodies) > 0, F.array_join(bodies, "\n\n")))
    joined = F.when(F.length(joined) > 0, joined).otherwise(F.trim(cleaned))
    start = F.substring(head, 1, limit // 3)
    cut = F.concat(start, F.lit("\n\nDOCUMENT:\n"), F.substring(F.trim(cleaned), F.lit(1), F.lit(limit - 20) - F.length(start)))
    return F.when(F.length(joined) <= limit, joined).when(head.isNotNull(), cut).otherwise(F.substring(joined, 1, limit))
