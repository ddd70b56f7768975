"""Document files (survey ids SRC-01 to SRC-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thicket.functions.markup import html_to_text, markdown_to_text, pdf_to_text

STRICT = ("pdf", "txt", "md", "html", "htm")
EXTENSIONS = (*STRICT, "markdown")


def extension(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./]+)$", 1)


def is_supported(path: Column | str, strict: bool = False) -> Column:
    """SRC-02: whether a file is read, by its extension; strict: in lower case, and without .markdown."""
    return extension(path).isin(*STRICT) if strict else F.lower(extension(path)).isin(*EXTENSIONS)


def scan(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """SRC-01: (source, content, modified) of the supported files under path, all folders below included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(is_supported("path", strict)).select(F.col("path").alias("source"), "content", F.col("modificationTime").alias("modified"))


@F.pandas_udf(StringType())
def _markdown(s):
    return s.map(markdown_to_text, na_action="ignore")


@F.pandas_udf(StringType())
def _html(s):
    return s.map(html_to_text, na_action="ignore")


@F.pandas_udf(StringType())
def _pdf(s):
    return s.map(lambda b: pdf_to_text(bytes(b)))


def parsed(files: DataFrame) -> DataFrame:
    """SRC-03 to SRC-07: (source, text) of scanned files, by extension. Bytes that aren't UTF-8 and files that aren't of
    their kind fail; so does an extension that no reader is for."""
    kind = F.lower(extension("source"))
    text = F.decode("content", "UTF-8")
    # Each reader sees its own files alone; a union keeps Python workers from rows that need none.
    parts = {("txt",): text, ("md", "markdown"): _markdown(text), ("html", "htm"): _html(text), ("pdf",): _pdf(F.col("content"))}
    known = [k for kinds in parts for k in kinds]
    out = files.where(~kind.isin(*known)).select("source", F.raise_error(F.concat(F.lit("Unsupported file type: "), "source")).cast("string").alias("text"))
    for kinds, column in parts.items():
        out = out.unionByName(files.where(kind.isin(*kinds)).select("source", column.alias("text")))
    return out


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parsed(scan(spark, path, strict))


def markdown_text(c: Column) -> Column:
    return _markdown(c)


def html_text(c: Column) -> Column:
    return _html(c)
