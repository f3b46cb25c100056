"""Document fingerprints: threshold-scaled sketches.

The shingles of a text are its runs of `size` code points (the whole text where it is shorter).
The sketch keeps every distinct shingle hash (32 bits) below a fixed fraction of the hash range, at
every length, so sketches of parts merge by union, and the containment of one text in another is
estimated from the share of its hashes that the other's sketch has, however unequal the two are in
length. A text of at most SMALL distinct shingles says too little that way: its fingerprint has, in
a field of its own behind a plus sign, the hashes above the threshold too, and two such texts are
compared on all of them.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, documents, mix, pick, text_bytes, text_pieces, written

BASE = np.uint64(0x9E3779B97F4A7C55)
#: Distinct shingles up to which a fingerprint holds them all.
SMALL = 64


def shingles(text: str, size: int) -> np.ndarray:
    """The 32-bit hashes of a text's shingles, in order, repeats kept."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    width = min(size, len(x))
    if not width:
        return x.astype(np.uint32)
    # polynomial hashes of runs of 1, 2, 4 ... code points; those that make up the width are joined
    run, w, power, left, h, done = x, 1, BASE, width, x[:0], 0
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                n = len(x) - done - w + 1
                h, done = (h[:n] * power + run[done : done + n] if done else run), done + w
            left >>= 1
            if not left:
                break
            run, w, power = run[:-w] * power + run[w:], 2 * w, power * power
        h = mix(h ^ (np.full(1, width, np.uint64) * GOLDEN))
    return (h >> np.uint64(32)).astype(np.uint32)


class Fingerprint:
    """kept: the sorted hashes below the threshold; rest: those above it, None where there are too many."""

    __slots__ = ("kept", "rest")

    def __init__(self, kept: np.ndarray, rest: np.ndarray | None):
        self.kept, self.rest = kept, rest

    def __str__(self) -> str:
        written = lambda x: base64.b64encode(x.astype("<u4").tobytes()).decode()
        return written(self.kept) if self.rest is None else f"{written(self.kept)}+{written(self.rest)}"

    def merged(self, other: Fingerprint) -> Fingerprint:
        """The fingerprint of both texts' shingles."""
        kept = np.union1d(self.kept, other.kept)
        rest = None if self.rest is None or other.rest is None else np.union1d(self.rest, other.rest)
        return Fingerprint(kept, rest if rest is not None and len(kept) + len(rest) <= SMALL else None)


def fingerprint(text: str, size: int = 12, one_in: int = 8) -> Fingerprint:
    found, line = shingles(text, size), 2**32 // one_in
    low = found < line
    kept = np.unique(found[low])
    rest = np.unique(found[~low]) if len(kept) <= SMALL else None
    return Fingerprint(kept, rest if rest is not None and len(kept) + len(rest) <= SMALL else None)


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the smaller one's shingles that the other has; two empty texts are alike, an empty one is like nothing else."""
    x, y = a.kept, b.kept
    if a.rest is not None and b.rest is not None:
        x, y = np.concatenate([x, a.rest]), np.concatenate([y, b.rest])
    if not len(x) or not len(y):
        return float(a.rest is not None and b.rest is not None and len(x) == len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Rows:
    """Output rows from pairs of a document and the next one."""

    def __init__(self, size: int, one_in: int):
        self.args, self.last = (size, one_in), ("", fingerprint("", size, one_in))
        self.rows: list[tuple] = []

    def of(self, text: str) -> Fingerprint:
        if self.last[0] is not text:
            self.last = (text, fingerprint(text, *self.args))
        return self.last[1]

    def add(self, doc_id, text: str, after: str) -> None:
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        own, changed, following = self.of(text), fingerprint(edited, *self.args), self.of(after)
        self.rows.append((doc_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), str(own), str(changed), containment(own, changed), containment(own, following)))

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)


def _within(size: int, one_in: int):
    """Sorted (bucket, doc_id, text): rows for all but the last of each bucket."""

    def run(batches):
        out, held = _Rows(size, one_in), None
        for batch in batches:
            texts = (t for _, some in text_pieces(batch.column(2)) for t in some)
            for bucket, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                row = (bucket, doc_id, text.decode("utf-8", "replace"))
                if held and held[0] == bucket:
                    out.add(held[1], held[2], row[2])
                held = row
            yield out.batch()

    return run


def _between(size: int, one_in: int):
    """(doc_id, text, after): one row each."""

    def run(batches):
        out = _Rows(size, one_in)
        for batch in batches:
            for doc_id, text, after in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), text_bytes(batch.column(2)), strict=True):
                out.add(doc_id, text.decode("utf-8", "replace"), after.decode("utf-8", "replace"))
            yield out.batch()

    return run


def fingerprints_with_edits(docs: DataFrame, *, size: int = 12, one_in: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the one with the next smaller doc_id; rows of one doc_id go by text, a
    null doc_id comes last, and after the last comes the first. The ids are cut at quantiles into
    as many buckets as there are shuffle partitions; each bucket is read in order, and the last
    document of each meets the first of the next non-empty bucket in a join of one row a bucket.
    A null text counts as empty; a single row is its own next; an empty table gives no rows; other
    columns are ignored. Memory: a batch of texts.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("cuts")).first()["cuts"] or []
    cut_at = F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<bigint>")
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("bucket", F.size(F.filter(cut_at, lambda c: c < F.col("key"))))
    dealt = docs.select("bucket", "doc_id", text.alias("text"), "key").repartitionById(n, F.col("bucket")).sortWithinPartitions(F.desc("bucket"), F.desc("key"), "text")
    inner = dealt.select("bucket", "doc_id", "text").mapInArrow(_within(size, one_in), _OUT)
    # the first and the last document of each bucket: two ids a bucket, then their texts
    ends = docs.groupBy("bucket").agg(F.max("key").alias("top"), F.min("key").alias("low"))
    ends = written(ends.withColumn("next", F.coalesce(F.lead("bucket").over(Window.orderBy(F.desc("bucket"))), F.max("bucket").over(Window.partitionBy()))), "ends")
    wanted = ends.select("bucket", F.explode(F.array_distinct(F.array("top", "low"))).alias("key"))
    found = written(docs.join(F.broadcast(wanted), ["bucket", "key"], "left_semi").groupBy("bucket", "key").agg(F.min(text).alias("first"), F.max(text).alias("last"), F.first("doc_id").alias("doc_id")), "end_texts")
    lasts = ends.join(found.select("bucket", F.col("key").alias("low"), "last", "doc_id"), ["bucket", "low"])
    firsts = ends.select(F.col("bucket").alias("next"), F.col("top").alias("key")).join(found.select(F.col("bucket").alias("next"), "key", F.col("first").alias("after")), ["next", "key"]).select("next", "after")
    outer = lasts.join(firsts, "next").select("doc_id", F.col("last").alias("text"), "after").mapInArrow(_between(size, one_in), _OUT)
    return inner.unionByName(outer)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(documents(spark, sf_dir))
