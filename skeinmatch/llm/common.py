"""Helpers that the text operators share: the shared folder, written tables, bounded text chunks, hashes."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised code handles at a time.
CHUNK_BYTES = 1 << 19
#: Rows in an Arrow batch on its way to a worker, so that long texts do not fill its memory.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode one of our own if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="skeinmatch-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session now sends workers batches of at most BATCH_ROWS rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def as_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, by Spark's default file system where it names none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more; frames of other origin are left alone."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path:
            context = t.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def open_fs(uri: str):
    """pyarrow's file system and the path in it, for files that are not Spark's own formats."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    return batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()


def chunked(texts: list[bytes | None], limit: int = CHUNK_BYTES):
    """(from, to) ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


class Memo:
    """A bounded map that forgets the older half when full.

    It holds at most twice `half` keys and those of two calls of `values`."""

    #: Keys of the first call that are kept apart for good, the most frequent first: a map that fits a processor's cache.
    HOT = 16384

    def __init__(self, half: int, hot: int = HOT):
        self.half, self.most, self.young, self.old, self.hot = half, hot, {}, {}, {}

    def values(self, lists: list[list], make):
        """Yields the list of values of each list of keys; make(keys) gives a map for those that are not remembered."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        young, old, hot = self.young, self.old, self.hot
        found = [list(map(hot.get, x)) for x in lists]
        keys = list(dict.fromkeys([k for x, y in zip(lists, found) for k, v in zip(x, y) if v is None]))
        here = dict(zip(keys, map(young.get, keys)))
        missing = [k for k, v in here.items() if v is None]
        again = {k: old[k] for k in missing if k in old} if old else {}
        again.update(make([k for k in missing if k not in again]))
        young.update(again)
        here.update(again)
        for x, y in zip(lists, found):
            yield [here[k] if v is None else v for k, v in zip(x, y)] if None in y else y
        if not hot and self.most:
            hot.update((k, here[k]) for k, _ in Counter(chain.from_iterable(lists)).most_common(self.most))


def trimmed(fn):
    """fn over batches, which at its end gives memory that the worker no longer uses back to the system: idle workers stay small."""

    def run(batches):
        import ctypes
        import gc

        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


@functools.lru_cache(maxsize=1)
def tokenizer_of(path: str):
    """The tokenizers library's tokenizer without truncation and padding; a worker reads its file once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hash_place(*columns: str):
    """A place from 0 to 2**62 - 1 for a row, by a hash of its columns."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def hash_share(most: int, size: int):
    """The places below which about `most` of `size` rows lie; never none, whatever the size."""
    return F.lit(max(1, min(1 << 62, (1 << 62) * most // max(size, 1)))).cast("bigint")


def filtered(df: DataFrame, keep_mask, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text keep_mask(list of texts) says True for. No shuffle."""

    def rows(batches):
        mask_of = keep_mask()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask_of(text_column(batch, text_col)), pa.bool_()))

    return bounded(df).mapInArrow(trimmed(rows), df.schema)
