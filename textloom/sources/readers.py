"""Sources: structured files, document files, archives, and several of them together."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from csv import DictReader
from functools import reduce
from io import BytesIO, StringIO
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import normalized_lines
from ..operators.capacity import skim_capacity, usable_pages
from ..operators.prefix import kept
from ..operators.sample import page_sample

DOCUMENTS = {".txt", ".md", ".markdown", ".html", ".htm", ".pdf", ".docx"}
STRUCTURED = {".json", ".jsonl", ".csv"}
#: Keys of an object that may hold its rows, the first that does counts.
WRAPPERS = ("rows", "records", "documents", "data", "items", "results")
MOST_SOURCES, MOST_BYTES, MOST_JSON = 50, 512 << 20, 128 << 20
DATASET_ID = re.compile(r"[\w.-]+/[\w.-]+")
#: What stands for a missing value of CSV while it is read. Spark takes every value equal to it for null, so it is none that a text has, least of all the empty one.
NO_VALUE = "\ue000textloom:no-value\ue001"
WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class SourceError(ValueError):
    """A source that cannot be read."""


def suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.casefold()


def kind_of(source: str) -> str:
    """url, path or dataset. A path that names a file of a known kind is no dataset."""
    if re.match(r"https?://", source, re.IGNORECASE):
        return "url"
    known = suffix(source) in DOCUMENTS | STRUCTURED | {".zip"}
    return "dataset" if DATASET_ID.fullmatch(source) and not known else "path"


def distinct_sources(sources: list[str], source: str | None = None) -> list[str]:
    """In order, stripped, without repeats."""
    return list(dict.fromkeys(s.strip() for s in [*(sources or []), *([source] if source else [])] if s and s.strip()))


def _parsed(objects: DataFrame) -> DataFrame:
    """Columns of JSON objects (value), by the schema that all of them share; values that differ in kind stay variants."""
    kind = objects.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    if not kind or not kind.startswith("OBJECT<"):
        return objects.select(F.lit(None).cast("string").alias("value")).where("false")
    return objects.select(F.from_json("value", kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")).alias("r")).select("r.*")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Objects of a file, one a line. Blank lines and other values are skipped; a line that is no JSON fails the job."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    objects = lines.where(F.schema_of_variant(F.parse_json("value")).startswith("OBJECT"))
    if schema is not None:
        return objects.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    return _parsed(objects)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a header, every value a string as it stands: a quoted value without signs is empty, one without quotes and signs is null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue=NO_VALUE)


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a JSON file: of its array, of the first wrapper that holds only objects (and any), else the object itself."""
    whole = spark.read.text(path, wholetext=True)
    if whole.where(F.length("value") > MOST_JSON).limit(1).count():
        raise SourceError(f"JSON above {MOST_JSON >> 20} MB: {path}")
    v = whole.select(F.parse_json("value").alias("v"))
    scalar = v.where(~F.schema_of_variant("v").startswith("OBJECT") & ~F.schema_of_variant("v").startswith("ARRAY"))
    if scalar.limit(1).count():
        raise SourceError(f"no objects in {path}")
    as_list = lambda c: F.try_variant_get(c, "$", "array<variant>")
    an_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    wrapped = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in WRAPPERS]
    found = F.coalesce(*[F.when((F.size(w) > 0) & F.forall(w, an_object), w) for w in wrapped])
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.filter(as_list(F.col("v")), an_object)).otherwise(F.coalesce(found, F.array("v")))
    return _parsed(v.select(F.explode(items).alias("r")).select(F.to_json("r").alias("value")))


def structured(spark: SparkSession, path: str) -> DataFrame:
    return {".jsonl": jsonl, ".csv": csv, ".json": json_rows}[suffix(path)](spark, path)


def sample_and_count(rows: DataFrame, limit: int = 200) -> tuple[list, int]:
    """The first rows and the number of all."""
    return rows.take(limit), rows.count()


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file that are not blank, a blank line between them."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{WORD_SPACE}t")).strip() for p in root.iter(f"{WORD_SPACE}p"))
    return "\n\n".join(p for p in found if p)


def pdf_text(raw: bytes) -> tuple[str, int]:
    """Pages of a PDF joined by page breaks, and their number. Needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise SourceError("PDF files need the optional package pypdf") from e
    pages = ["\n\n".join(x.strip() for x in (p.extract_text() or "").splitlines() if x.strip()) for p in PdfReader(BytesIO(raw)).pages]
    return "\f".join(p for p in pages if p), len(pages)


def _text_of(name: str, raw: bytes, native=pdf_text) -> tuple[str, int | None]:
    kind = suffix(name)
    if kind == ".docx":
        return docx_text(raw), None
    if kind == ".pdf":
        return native(raw)
    return raw.decode("utf-8", errors="replace"), None


def ocr_pages(pdfs: DataFrame, ocr, limit: int = 0, seed: int = 42, group: int = 16) -> DataFrame:
    """(doc_id, ocr_text, read) of paged files (doc_id, content, page_count): ocr, a function from a file's bytes and page numbers (from 1) to those pages' texts, reads all or `limit` pages.

    Groups of pages go to tasks of their own, wherever these run, and come together in the order of their numbers.
    """
    pages = pdfs.withColumn("pages", page_sample(F.col("page_count"), limit, seed)).where(F.size("pages") > 0)
    last = F.ceil(F.size("pages") / group).cast("int") - 1
    parts = pages.select("doc_id", "content", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("pages", i * group + 1, group))).alias("part", "pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, page, text = [], [], []
            for i, raw, _, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = ocr(raw, numbers)
                ids += [i] * len(numbers)
                page += numbers
                text += [(t or "").strip() for t in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(page, pa.int32()), pa.array(text, pa.string())], ["doc_id", "page", "text"])

    read = parts.repartition("doc_id", "part").mapInArrow(run, "doc_id string, page int, text string").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    full = F.filter(F.transform("ps", lambda x: x["text"]), lambda x: F.length(x) > 0)
    return read.select("doc_id", F.array_join(full, "\f").alias("ocr_text"), F.size("ps").alias("read"))


def document_files(spark: SparkSession, path: str, ocr=None, light_chars: int = 0, ocr_limit: int = 0, native=pdf_text, seed: int = 42) -> DataFrame:
    """(doc_id, title, text, page_count, capacity_chars) of the document files under a path, blank ones left out.

    Paged files go by native text where that is dense enough; else by ocr (see ocr_pages()) if it is given and finds text; else by sparse native text; a paged file with none of these fails the job.
    light_chars cuts texts, and ocr_limit the pages that are read, not the stated capacity.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1))).isin(sorted(DOCUMENTS)))
    root = path.split(":", 1)[-1].rstrip("/") if "://" not in path else path.split("://", 1)[1].rstrip("/")
    schema = pa.schema([("doc_id", pa.string()), ("title", pa.string()), ("text", pa.string()), ("page_count", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, pages = _text_of(name, raw, native)
                at = name.find(root)
                rel = name[at + len(root) :].lstrip("/") if at >= 0 else name
                out.append({"doc_id": rel or name, "title": PurePosixPath(name).stem, "text": text, "page_count": pages, "content": raw if pages is not None and ocr is not None else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    read = files.select("path", "content").mapInArrow(run, "doc_id string, title string, text string, page_count int, content binary")
    chars = F.length(F.replace("text", F.lit("\f"), F.lit("")))
    stated = chars.cast("long")
    if ocr is not None:
        read = kept(read.withColumn("sparse", F.coalesce(~usable_pages(F.col("text"), F.col("page_count")), F.lit(False))))
        found = ocr_pages(read.where("sparse and page_count > 0").select("doc_id", "content", "page_count"), ocr, ocr_limit, seed)
        read = read.drop("content").join(found, "doc_id", "left")
        by_ocr = F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) > 0
        read = read.withColumn("text", F.when(by_ocr, F.col("ocr_text")).otherwise(F.col("text")))
        stated = F.when(by_ocr, skim_capacity(chars, F.col("read"), F.col("page_count"))).otherwise(chars).cast("long")
    none = F.col("page_count").isNotNull() & (F.length(F.trim("text")) == 0)
    text = F.when(none, F.raise_error(F.concat(F.lit("no text in "), F.col("doc_id"))).cast("string")).otherwise(F.substring("text", 1, light_chars) if light_chars else F.col("text"))
    return read.select("doc_id", "title", text.alias("text"), "page_count", stated.alias("capacity_chars")).where(F.length(F.trim("text")) > 0)


def zip_members(raw: bytes, most: int = MOST_BYTES) -> Iterator[tuple[str, bytes]]:
    """Members of an archive with safe names; an archive that unpacks to more than `most` fails."""
    total = 0
    with zipfile.ZipFile(BytesIO(raw)) as z:
        for info in z.infolist():
            name = PurePosixPath(info.filename.replace("\\", "/"))
            if info.is_dir() or name.is_absolute() or ".." in name.parts:
                continue
            total += info.file_size
            if total > most:
                raise SourceError(f"the archive unpacks to more than {most >> 20} MB")
            yield str(name), z.read(info)


def zipped_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of the document files in archives; archives in archives stay shut. Structured members are rows of their own: zipped_rows() reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = [{"doc_id": n, "title": PurePosixPath(n).stem, "text": _text_of(n, data)[0]} for n, data in zip_members(raw) if suffix(n) in DOCUMENTS]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.string()), ("title", pa.string()), ("text", pa.string())]))

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id string, title string, text string")
    return read.where(F.length(F.trim("text")) > 0)


def zipped_rows(spark: SparkSession, path: str) -> DataFrame:
    """(member, value) of the JSON objects in the structured members of archives: lines, items of arrays or first wrappers, and rows of CSV files as objects of strings."""

    def objects(name: str, data: bytes) -> Iterator[object]:
        text = data.decode("utf-8-sig", errors="replace")
        if suffix(name) == ".csv":
            yield from DictReader(StringIO(text))
        elif suffix(name) == ".jsonl":
            yield from (json.loads(line) for line in text.splitlines() if line.strip())
        else:
            whole = json.loads(text)
            lists = [whole] if isinstance(whole, list) else [whole[k] for k in WRAPPERS if isinstance(whole, dict) and isinstance(whole.get(k), list) and whole[k] and all(isinstance(x, dict) for x in whole[k])]
            yield from lists[0] if lists else [whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = [(n, json.dumps(x)) for n, data in zip_members(raw) if suffix(n) in STRUCTURED for x in objects(n, data) if isinstance(x, dict)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], ["member", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, value string")


def extracted(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts of native extraction with their lines normalized."""
    return df.withColumn(text, normalized_lines(F.col(text)))


def several(parts: list[DataFrame]) -> DataFrame:
    """Documents of several sources together; fifty at most."""
    if not 1 <= len(parts) <= MOST_SOURCES:
        raise SourceError(f"1 to {MOST_SOURCES} sources, not {len(parts)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
