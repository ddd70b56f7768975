"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from thicket.functions.persist import cut as staged  # noqa: F401
from thicket.functions.persist import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the same where every character is one byte, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def broadcast_if(df: DataFrame, size: int, most: int) -> DataFrame:
    """df with a broadcast hint if its measured size is within the bound; else as it is, and Spark shuffles."""
    return F.broadcast(df) if size <= most else df


def for_python(docs: DataFrame, text_col: str, without: list[str], keep_text: bool = True) -> tuple[DataFrame, int, list[str]]:
    """(what a task gets, the place of the text in it, the columns that it gives back): docs without some columns, and
    with the text once; keep_text leaves it out of what comes back."""
    kept = [c for c in docs.columns if c not in without]
    given = docs.select(*kept)
    back = [c for c in kept if keep_text or c != text_col]
    if text_col in kept and given.schema[text_col].dataType == StringType():
        return given, kept.index(text_col), back
    return given.select(*kept, F.col(text_col).cast("string").alias(unused("text", kept))), len(kept), back


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that none of taken has, whatever their case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and the fields of ddl after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


@contextmanager
def memory_returned() -> Iterator[None]:
    """At the end, what a task has freed goes back to the system: its worker lives on, idle while other stages run."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Python's search for cycles rests meanwhile: a task that makes millions of small objects and no cycles needs none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        gc.collect()
