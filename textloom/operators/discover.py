"""Which columns hold the text, the id and the title: paths flattened, profiled and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH, ITEMS, CANDIDATES, METADATA = 8, 8, 5, 8
# Weights of the last name of a path.
TEXT_NAMES = {
    "opinion_text": 14, "full_text": 14, "document_text": 14, "html_content": 13, "unofficial_text_en": 13, "text": 12, "content": 11, "body": 10, "document": 10,
    "description": 8, "opinion": 8, "transcript": 8, "article": 7, "summary": 4, "syllabus": 4, "headnotes": 3,
}
# Words in a path that speak against text; names of ids, titles and metadata, the best first.
NOT_TEXT = "id uuid slug url path date name title citation".split()
ID_NAMES = "id _id uuid slug document_id case_id citation".split()
TITLE_NAMES = "title case_name name case_name_short case_name_full headline subject slug".split()
METADATA_NAMES = "date_filed court_full_name court_short_name court_jurisdiction precedential_status disposition nature_of_suit language category jurisdiction date".split()
ID_CHARS, TITLE_CHARS = 300, 500


def flat(rows: DataFrame) -> DataFrame:
    """(row, path, kind, value) for each scalar leaf of rows that is not null: structs by dots, lists by [] (their first ITEMS items), DEPTH deep. kind is string, integer or other."""

    def leaves(c: Column, kind: T.DataType, path: str, depth: int) -> list[Column]:
        if depth > DEPTH:
            return []
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, depth + 1)]
        if isinstance(kind, T.ArrayType):
            return [x for i in range(ITEMS) for x in leaves(F.get(c, i), kind.elementType, f"{path}[]", depth + 1)]
        name = "string" if isinstance(kind, T.StringType) else "integer" if isinstance(kind, (T.IntegralType, T.BooleanType)) else "other"
        return [F.struct(F.lit(path).alias("path"), F.lit(name).alias("kind"), c.cast("string").alias("value"))]

    found = [x for f in rows.schema for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name, 1)]
    cells = rows.select(F.monotonically_increasing_id().alias("row"), F.inline(F.array(*found)))
    return cells.where("value is not null")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(F.replace(F.lower(path), F.lit("[]"), F.lit("")), r"\."), -1)


def text_name_score(path: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for k, v in TEXT_NAMES.items() for x in (k, float(v))])
    words = F.split(F.regexp_replace(F.replace(F.lower(path), F.lit("[]"), F.lit("")), "-", "_"), "[._]")
    return F.coalesce(F.element_at(weights, leaf(path)), F.lit(0.0)) - F.when(F.arrays_overlap(words, F.array(*map(F.lit, NOT_TEXT))), 9.0).otherwise(0.0)


def text_candidates(cells: DataFrame, n_rows: int) -> DataFrame:
    """(path, score, coverage, average_chars) of paths with text, unsorted."""
    own = cells.where("kind = 'string'").withColumn("chars", F.length(F.trim("value"))).where("chars > 0")
    g = own.groupBy("path").agg(F.avg("chars").alias("average"), F.count(F.lit(1)).alias("n"))
    coverage = F.col("n") / F.lit(max(1, n_rows))
    score = text_name_score(F.col("path")) + F.least(F.log10(F.col("average") + 1) * 2.5, F.lit(11.0)) + coverage * 4 - F.when(F.col("average") < 80, 8.0).otherwise(0.0)
    return g.select("path", F.bround(score, 3).alias("score"), F.bround(F.least(coverage, F.lit(1.0)), 3).alias("coverage"), F.bround("average", 0).cast("long").alias("average_chars"))


def scalar_candidates(cells: DataFrame, n_rows: int, names: list[str], most_chars: int) -> DataFrame:
    """(path, score) of paths outside lists that may hold an id or a title, unsorted."""
    own = cells.where("kind in ('string', 'integer') and value <> '' and not contains(path, '[]')")
    g = own.groupBy("path").agg(F.avg(F.length("value")).alias("average"), F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("kinds")).where(F.col("average") <= most_chars)
    weights = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, 12 - 1.5 * i)])
    score = F.coalesce(F.element_at(weights, leaf(F.col("path"))), F.lit(0.0)) + F.col("kinds") / F.col("n") * 4 + F.col("n") / F.lit(max(1, n_rows)) * 2
    return g.select("path", score.alias("score"))


def best_path(candidates: DataFrame) -> DataFrame:
    """The path of the highest score; of equal scores the greatest name."""
    return candidates.agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def discover(sample: DataFrame, text: str | None = None, id_: str | None = None, title: str | None = None, metadata: list[str] | None = None) -> dict:
    """The schema of a bounded sample of rows: names of columns, confidence, and the best candidates. A given text column is certain."""
    sample = sample.cache()
    try:
        return _discover(sample, text, id_, title, metadata)
    finally:
        sample.unpersist()


def _discover(sample: DataFrame, text: str | None, id_: str | None, title: str | None, metadata: list[str] | None) -> dict:
    n = sample.count()
    if not n:
        raise ValueError("no rows to discover a schema from")
    cells = flat(sample)
    best = text_candidates(cells, n).orderBy(F.desc("score"), F.desc("average_chars"), "path").limit(CANDIDATES).collect()
    if not (text or best):
        raise ValueError("no column holds text")
    text_path = text or best[0]["path"]
    id_path = id_ or best_path(scalar_candidates(cells, n, ID_NAMES, ID_CHARS)).first()["path"]
    title_path = title or best_path(scalar_candidates(cells, n, TITLE_NAMES, TITLE_CHARS)).first()["path"]
    margin = best[0]["score"] - best[1]["score"] if len(best) > 1 else best[0]["score"] if best else 0
    others = metadata or [c for c in METADATA_NAMES if c in sample.columns and c not in (text_path, id_path, title_path)][:METADATA]
    return {
        "text_column": text_path, "id_column": id_path, "title_column": title_path, "metadata_columns": others, "sampled_rows": n,
        "confidence": 1.0 if text else round(max(0.05, min(0.99, 0.55 + margin / 20)), 3), "text_candidates": [b.asDict() for b in best],
    }


def values_at(rows: DataFrame, path: str) -> Column:
    """All values at a path, as an array: a dot enters a struct (through lists too), [] a list's items."""
    steps = path.split(".")
    col, kind, many = F.col(f"`{steps[0].removesuffix('[]')}`"), rows.schema[steps[0].removesuffix("[]")].dataType, False
    for k, step in enumerate(steps):
        if k:
            name = step.removesuffix("[]")
            element = kind.elementType if isinstance(kind, T.ArrayType) and not many else kind
            if isinstance(kind, T.ArrayType) and not many:
                many = True
            kind = element[name].dataType
            col = F.transform(col, _field(name)) if many else col[name]
        if step.endswith("[]") and isinstance(kind, T.ArrayType):
            col, kind, many = (F.flatten(col) if many else col), kind.elementType, True
    return col if many else F.array(col)


def _field(name: str):
    return lambda x: x[name]


def joined_text(values: Column) -> Column:
    """Distinct stripped texts in order, a blank line between them."""
    stripped = F.transform(values, lambda x: F.trim(x.cast("string")))
    return F.array_join(F.array_distinct(F.filter(stripped, lambda x: x.isNotNull() & (F.length(x) > 0))), "\n\n")


def documents(rows: DataFrame, schema: dict, source: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text, title, metadata) of rows with text. An id that is missing is made of the source, the text's hash and a number among equal texts, so it does not depend on partitions; a missing title is the id."""
    one = lambda p: F.trim(F.get(values_at(rows, p), 0).cast("string")) if p else F.lit(None).cast("string")
    d = rows.select(
        joined_text(values_at(rows, schema["text_column"])).alias("text"), F.nullif(one(schema["id_column"]), F.lit("")).alias("id"), F.nullif(one(schema["title_column"]), F.lit("")).alias("title"),
        F.create_map(*[x for c in schema["metadata_columns"] for x in (F.lit(c), one(c))]).cast("map<string,string>").alias("metadata"),
    ).where(F.length("text") > 0)
    named = d.where("id is not null").withColumn("doc_id", F.col("id"))
    hashed = d.where("id is null").withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    number = F.row_number().over(Window.partitionBy("hash").orderBy("title"))
    nameless = hashed.withColumn("n", number).withColumn("doc_id", F.concat_ws(":", F.lit(source), F.substring("hash", 1, 16), "n"))
    columns = ["doc_id", "text", F.coalesce("title", "doc_id").alias("title"), "metadata"]
    d = named.select(*columns).unionByName(nameless.select(*columns))
    return d if limit is None else d.limit(limit)
