"""How much a source can give: characters, pages, pools and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_PAGE, CHARS_PER_ROW, PERSONA_MIX, POOL = 1800, 50.0, 5.0, 5000
LEAST_PAGE_CHARS, LEAST_PAGE_SHARE = 40, 0.2


def corpus_chars(docs: DataFrame) -> DataFrame:
    """chars: the stated capacity of each document (capacity_chars) where it is positive, else its length."""
    stated = F.when(F.col("capacity_chars") > 0, F.col("capacity_chars"))
    return docs.agg(F.coalesce(F.sum(F.coalesce(stated, F.length("text"), F.lit(0))), F.lit(0)).cast("long").alias("chars"))


def page_count(docs: DataFrame) -> DataFrame:
    """pages: stated counts (page_count) if any document has one; else page breaks; else characters by CHARS_PER_PAGE, one at least; null without text."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\f"), F.lit("")))
    stated = F.when(F.col("page_count") > 0, F.col("page_count"))
    chars = F.coalesce(F.when(F.col("capacity_chars") > 0, F.col("capacity_chars")), F.length("text"), F.lit(0))
    g = docs.agg(F.sum(stated).alias("stated"), F.sum(F.when(stated.isNull() & (breaks > 0), breaks + 1)).alias("broken"), F.sum(chars).alias("chars"))
    return g.select(F.coalesce("stated", "broken", F.when(F.col("chars") > 0, F.greatest(F.lit(1), F.bround(F.col("chars") / CHARS_PER_PAGE)))).cast("long").alias("pages"))


def rows_from_chars(chars: Column, personas: int) -> Column:
    return F.floor(chars / CHARS_PER_ROW * max(1.0, personas / PERSONA_MIX)).cast("long")


def pool_capacity(pool: DataFrame, tasks: int = 3) -> DataFrame:
    """(persona, pool_size, capacity): pools, capped for each document, times the passes over them."""
    per_doc = pool.groupBy("persona", "doc_id").agg(F.least(F.count(F.lit(1)), F.lit(POOL)).alias("n"))
    return per_doc.groupBy("persona").agg(F.sum("n").alias("pool_size")).withColumn("capacity", F.col("pool_size") * max(1, min(4, tasks or 3)))


def extrapolated(sample_rows: Column, sample_chars: Column, chars: Column, personas: int) -> Column:
    """The most of the sample carried on to the corpus, the floor by characters, and the sample."""
    scaled = F.when(sample_chars > 0, F.floor(sample_rows * chars / sample_chars)).otherwise(0)
    return F.greatest(scaled, rows_from_chars(chars, personas), sample_rows).cast("long")


def skim_capacity(chars: Column, attempted: Column, total: Column) -> Column:
    """Characters of a document of which some pages were read."""
    return F.when((chars <= 0), 0).when((attempted <= 0) | (total <= attempted), chars).otherwise(F.greatest(chars, F.floor(chars * (total / attempted)))).cast("long")


def usable_pages(text: Column, pages: Column) -> Column:
    """Whether native text of a paged document is dense enough to do without OCR."""
    parts = F.when(text.contains("\f"), F.split(text, "\f")).otherwise(F.split(text, "\n\n"))
    full = F.size(F.filter(parts, lambda p: F.length(F.trim(p)) > 0))
    chars = F.length(F.replace(text, F.lit("\f"), F.lit("")))
    return F.when(pages <= 0, F.length(F.trim(text)) > 0).otherwise((chars / pages >= LEAST_PAGE_CHARS) & (full / pages >= LEAST_PAGE_SHARE))


def label_coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, documents, labelled, coverage): how many documents have a label."""
    g = docs.join(labels.select("doc_id", F.lit(1).alias("has")).dropDuplicates(["doc_id"]), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("labelled"))
    return g.withColumn("coverage", F.col("labelled") / F.col("documents"))
