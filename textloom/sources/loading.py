"""Documents of a request's sources: files, folders, archives, datasets and addresses, one or several together."""

from __future__ import annotations

import os
import re
import urllib.request
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discover
from ..operators.sample import order_key
from . import readers
from .readers import DOCUMENTS, MOST_BYTES, MOST_SOURCES, STRUCTURED, SourceError

#: Rows that a schema is discovered from; seconds that a download may take; bytes that are read at once.
SCHEMA_ROWS, TIMEOUT, PIECE = 32, 120, 1 << 20
COLUMNS = ["doc_id", "title", "text", "metadata", "page_count", "capacity_chars"]


def _document_columns(df: DataFrame) -> DataFrame:
    """df with all of COLUMNS, nulls where it lacks them."""
    kinds = {"metadata": "map<string,string>", "page_count": "int", "capacity_chars": "long"}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS])


def in_order(docs: DataFrame, seed: int, limit: int | None) -> DataFrame:
    """The first documents of a stable order by hash, all if there is no limit."""
    if limit is None:
        return docs
    return docs.withColumn("_key", order_key(seed, "load", F.col("doc_id"))).orderBy("_key", "doc_id").limit(limit).drop("_key")


def from_rows(rows: DataFrame, source: str, limit: int | None = None, seed: int = 42, **columns) -> DataFrame:
    """Documents of structured rows, by the schema of the first SCHEMA_ROWS of them; with a limit, from the first max(limit, SCHEMA_ROWS) rows, in the order of their hashes."""
    schema = discover.discover(rows.limit(SCHEMA_ROWS), **columns)
    if limit is not None:
        rows = rows.limit(max(limit, SCHEMA_ROWS))
    return in_order(_document_columns(discover.documents(rows, schema, source)), seed, limit)


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files under a path that may be read, sorted. Only names come to the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        raise SourceError(f"no such path: {path}")
    found, each = [], fs.listFiles(root, True)
    while each.hasNext():
        name = each.next().getPath().toString()
        if readers.suffix(name) in DOCUMENTS | STRUCTURED:
            found.append(name)
    return sorted(found)


def folder(spark: SparkSession, path: str, limit: int | None = None, seed: int = 42, **files) -> DataFrame:
    """Documents of all files of known kinds under a path: document files are one each, structured files hold rows."""
    known = _files(spark, path)
    if not known:
        raise SourceError(f"no file of a known kind under {path}")
    parts = []
    if any(readers.suffix(f) in DOCUMENTS for f in known):
        parts.append(_document_columns(readers.document_files(spark, path, **files)))
    parts += [from_rows(readers.structured(spark, f), PurePosixPath(f).name, limit, seed) for f in known if readers.suffix(f) in STRUCTURED]
    return in_order(reduce(DataFrame.unionByName, parts), seed, limit)


def dataset(spark: SparkSession, name: str, root: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Documents of a dataset (owner/name) that is mirrored under a root as Parquet or structured files; there is no network to stream it from."""
    if not readers.DATASET_ID.fullmatch(name):
        raise SourceError(f"no dataset: {name}")
    path = f"{root.rstrip('/')}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        raise SourceError(f"the dataset {name} is not mirrored under {root}")
    files = _files(spark, path)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [readers.structured(spark, f) for f in files]) if files else spark.read.option("recursiveFileLookup", True).parquet(path)
    return from_rows(rows, name, limit, seed)


def download(address: str, folder_: str, most: int = MOST_BYTES, timeout: int = TIMEOUT) -> str:
    """The path of what an address gives, saved in a folder of the driver. More than `most` bytes, by the header or as they come, and nothing at all are errors."""
    with urllib.request.urlopen(address, timeout=timeout) as answer:  # noqa: S310
        told = answer.headers.get("Content-Length")
        if told and told.isdigit() and int(told) > most:
            raise SourceError(f"{address} has more than {most} bytes")
        name = re.sub(r"[^\w.-]+", "_", PurePosixPath(re.sub(r"[?#].*", "", address)).name) or "download"
        if readers.suffix(name) not in DOCUMENTS | STRUCTURED | {".zip"}:
            name += ".html" if "html" in (answer.headers.get("Content-Type") or "") else ".txt"
        path, size = os.path.join(folder_, name), 0
        with open(path, "wb") as out:
            while piece := answer.read(PIECE):
                size += len(piece)
                if size > most:
                    break
                out.write(piece)
    if not 0 < size <= most:
        os.remove(path)
        raise SourceError(f"{address} has more than {most} bytes" if size else f"{address} is empty")
    return path


def _bytes(spark: SparkSession, path: str) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).getContentSummary(at).getLength()


def load(spark: SparkSession, source: str, limit: int | None = None, seed: int = 42, mirror: str | None = None, staging: str | None = None, **files) -> DataFrame:
    """Documents of one source: an address (downloaded to `staging`), a dataset (under `mirror`), a folder, an archive, a structured file or a document file."""
    kind = readers.kind_of(source)
    if kind == "url":
        if staging is None:
            raise SourceError("an address needs a staging folder that driver and executors share")
        return load(spark, download(source, staging), limit, seed, mirror, staging, **files)
    if kind == "dataset" and mirror is not None:
        return dataset(spark, source, mirror, limit, seed)
    end = readers.suffix(source)
    if end == ".zip":
        parts = [_document_columns(readers.zipped_documents(spark, source))]
        inside = readers.zipped_rows(spark, source)
        for member in [r["member"] for r in inside.select("member").distinct().orderBy("member").collect()]:  # names of files of one archive
            parts.append(from_rows(readers._parsed(inside.where(F.col("member") == member).select("value")), member, limit, seed))
        return in_order(reduce(DataFrame.unionByName, parts), seed, limit)
    if end in STRUCTURED:
        return from_rows(readers.structured(spark, source), PurePosixPath(source).name, limit, seed)
    if end in DOCUMENTS:
        return in_order(_document_columns(readers.document_files(spark, source, **files)), seed, limit)
    return folder(spark, source, limit, seed, **files)


def load_all(spark: SparkSession, sources: list[str], limit: int | None = None, seed: int = 42, mirror: str | None = None, most: int = MOST_BYTES, **more) -> DataFrame:
    """Documents of several sources together: MOST_SOURCES and `most` bytes at most, a dataset only by itself."""
    sources = readers.distinct_sources(sources)
    if not 1 <= len(sources) <= MOST_SOURCES:
        raise SourceError(f"1 to {MOST_SOURCES} sources, not {len(sources)}")
    kinds = [readers.kind_of(s) if mirror is not None or readers.kind_of(s) != "dataset" else "path" for s in sources]
    if "dataset" in kinds and len(sources) > 1:
        raise SourceError("a dataset must be the only source")
    total = sum(_bytes(spark, s) for s, k in zip(sources, kinds, strict=True) if k == "path")
    if total > most:
        raise SourceError(f"the sources have more than {most} bytes together")
    return in_order(readers.several([load(spark, s, limit, seed, mirror, **more) for s in sources]), seed, limit)
