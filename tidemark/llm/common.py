"""Helpers that the corpus operators share: shared-folder tables, Arrow batches, model shipping."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space as the tokenizers' regular expressions know it (the Unicode White_Space property).
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those but blank and line end.
RARE_SPACES = r"\t\v-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local[...] session, where everything is one process, may go without the
    setting: then a temporary folder is made and kept for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, what: str, level: int = 3, page: int = 1 << 20) -> DataFrame:
    """df, written once as Parquet (zstd of this level, pages of so many bytes) to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored() tables that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def tokenizer_file(path: str) -> str:
    """A tokenizer's file as this process finds it: an executor may have the package elsewhere than the driver."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def free_name(columns: Iterable[str], base: str) -> str:
    """A column name that none of these columns has, whatever their case."""
    taken, name = {x.lower() for x in columns}, base
    while name.lower() in taken:
        name += " "
    return name


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return what this process has freed to the system; Arrow and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def tidied(run: Callable) -> Callable:
    """run (over the batches of a task, a group or a pair of groups), which gives back its memory at its end.

    Spark keeps Python workers beside those of later stages, with all that they hold.
    """

    def stream(batches):
        yield from run(batches)
        give_back()

    def group(table):
        out = run(table)
        give_back()
        return out

    def pair(left, right):
        out = run(left, right)
        give_back()
        return out

    # Spark counts the parameters.
    if inspect.isgeneratorfunction(run):
        return stream
    return group if len(inspect.signature(run).parameters) == 1 else pair


def with_text(table: pa.RecordBatch | pa.Table, texts: list[str]):
    """The same columns with another text, and n_chars (where there is one) of that text."""
    for i, f in enumerate(table.schema):
        if f.name == "text":
            table = table.set_column(i, f.name, pa.array(texts, f.type))
        elif f.name == "n_chars":
            table = table.set_column(i, f.name, pa.array([len(x) for x in texts], f.type))
    return table


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of rows whose sizes add up to about limit; a larger row stands alone."""
    start = total = i = 0
    for i, n in enumerate(sizes, 1):
        if total and total + n > limit:
            yield start, i - 1
            start, total = i - 1, 0
        total += n
    if i > start:
        yield start, i


def hash_ranges(h: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit hashes dealt to n buckets; the bucket does not fall as the hash rises."""
    if not len(h):
        return []
    p = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    first = np.append(True, p[1:] != p[:-1]).nonzero()[0]
    return list(zip(p[first].tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit. Works on a copy."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, None)):
        x ^= x >> np.uint64(shift)
        if factor is not None:
            x *= np.uint64(factor)
    return x
