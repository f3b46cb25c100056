"""Shared helpers: durable intermediate tables, Arrow maps over texts, 64-bit hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python-side work on texts goes in pieces of about this many characters.
PIECE_CHARS = 2_000_000

_fallback_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where none is set, a fresh local one in local mode; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback_dir:
        _fallback_dir.append(tempfile.mkdtemp(prefix="sitelens-"))
    return _fallback_dir[0]


def written(df: DataFrame, tag: str, *, tidy: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and lost executors cost nothing. tidy: the shuffle files behind it go at once, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitelens/{tag}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None) if tidy else None
    if before is not None:
        spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        own = re.sub("^file:/+", "/", f"{shared_dir(spark)}/sitelens/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Have the driver let go of broadcasts, shuffles and plans that nothing refers to any more, and of the heap that they took."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checked_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table with one row a language, source or the like: broadcast where it has at most `most` rows, so that joins with it deal nothing out by so few keys."""
    df = written(df, "small")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_enough(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` (narrow) rows; else as it is, for a shuffled join. Counted on the table: df should be a written one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: str, *, how: str = "inner", hottest: int = 100_000, least: int = 500, few: int = 0) -> DataFrame:
    """rows joined (inner or left) with table (a written one; one row a key) by key, without its column n.

    n says how many of the rows have the key. Keys with more than one in `hottest` of all counted
    rows (and more than `least`) are joined by broadcast, so that none fills a task; there are
    fewer than `hottest` of them. The others are joined by a shuffle. A table of at most `few`
    (narrow) rows is broadcast as a whole.
    """
    found = table.agg(F.sum(n).alias("all"), F.max(n).alias("most"), F.count("*").alias("keys")).first()
    if few and found["keys"] <= few:
        return rows.join(F.broadcast(table.drop(n)), key, how)
    line = max(least, (found["all"] or 0) // hottest)
    if (found["most"] or 0) <= line:
        return rows.join(table.drop(n), key, how)
    hot = F.col(n) > line
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(table.where(hot).drop(n)), key).unionByName(rest.join(table.where(~hot).drop(n), key, how))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that clashing or extra names of the input stay out of the way."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def pieces(sizes: np.ndarray, most: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`, one row at least."""
    at, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < n:
        end = int(np.searchsorted(total, total[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def text_pieces(column: pa.Array, most: int = PIECE_CHARS) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 of the texts) of pieces of a column of about `most` bytes, one text at least; only one piece is copied at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, end in pieces(sizes, most):
        yield at, text_bytes(column.slice(at, end - at))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.most, self.digest = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (one for the whole if there are fewer; none without words), in order, repeats kept."""
    n = len(words)
    if not n:
        return words
    w = min(n, k)
    h = np.full(n - w + 1, w, np.uint64) * GOLDEN
    for j in range(w):
        h = mix(h ^ words[j : n - w + 1 + j]) + GOLDEN
    return h


def crc_fold(column: str, mod: int):
    """crc32 of the id as text, mod `mod`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
