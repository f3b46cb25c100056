"""Sequence packing by minimum bin slack.

A document is its token ids and an end id. Whole windows of it become sequences of their own;
what remains is a length below the window. Only the number of documents of each remaining length
matters for the plan, so the plan is made on the driver from at most `window` counts: the longest
remaining length opens a window, and a bitset subset-sum over the multiset of the other lengths
(counts split into powers of two, backtracked to counts) fills it as close to capacity as it gets.
A fill is repeated as often as its counts allow. Where the best fill leaves slack, one more document
(of the largest remaining length; all that are left are longer than the slack) is cut: its first
ids fill the slack, the others go to a stream, which is cut freely at window ends. So does what is
left when no document can be cut any more; the stream's last window is cut into powers of two,
which need no padding. Documents find their place by their rank
among the documents of the same remaining length, counted in buckets so that a common length is
spread over many tasks.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, pick, pieces, text_bytes, written

_SAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]")
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The byte-level pre-tokens of texts that hold none of the characters in _SAFE.
_FAST = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\t\n\r {_LETTERS}{_DIGITS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


#: How byte-level models write bytes: printable Latin-1 as itself, the other bytes from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: b for b in _PRINTED} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def is_plain_byte_level(tokenizer) -> bool:
    """Whether texts can be cut by _FAST and each part given to the model alone."""
    found = json.loads(tokenizer.to_str())
    cut = found.get("pre_tokenizer") or {}
    return sys.byteorder == "little" and not found.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and found["model"].get("type", "BPE") == "BPE"


class TokenBytes(dict):
    """The ids of a pre-token as little-endian uint32, remembered for the last `most` to 2 * `most` distinct ones."""

    def __init__(self, tokenizer, most: int = 450_000):
        super().__init__()
        self.tokenizer, self.most, self.older = tokenizer, most, {}
        self.model, self.split = tokenizer.model, is_plain_byte_level(tokenizer)
        self.added = [t["content"] for t in json.loads(tokenizer.to_str()).get("added_tokens") or []]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not self.split or _SAFE.search(text) or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _FAST.findall(text)))


def load_tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


def _tokenize(path: str | None, end_id: int, window: int):
    def run(batches):
        from zlib import crc32

        cache = TokenBytes(load_tokenizer(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = text_bytes(batch.column(1))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for at, stop in pieces(sizes):
                n, crc, full, rest = [], [], [], []
                for t in texts[at:stop]:
                    ids = cache.of(t.decode("utf-8", "replace")) + end
                    whole = len(ids) // (4 * window)
                    n.append(len(ids) // 4)
                    crc.append(crc32(ids))
                    full.append([crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)])
                    tail = np.frombuffer(ids, "<u4", offset=4 * window * whole)
                    rest.append((tail if tail.size and tail.max() > 65535 else tail.astype("<u2")).tobytes())
                yield pa.record_batch([batch.column(0).slice(at, stop - at).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())], names=["doc_id", "doc_tokens", "crc", "full_crcs", "rest"])

    return run


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum is closest to capacity from below.

    Bit s of a bitset says that sum s can be made. Each length's count is split into powers of
    two; the bitsets before each part are kept, and the way back from the best sum gives the counts.
    """
    mask, reach, trail = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class Plan:
    """Where the document of a remaining length and a rank among its like goes."""

    def __init__(self, counts: dict[int, int], window: int):
        self.window = window
        left = {k: v for k, v in counts.items() if v and 0 < k < window}
        used = dict.fromkeys(left, 0)
        #: by length: (first rank, copies a window, offset, first sequence, ids there, position of the others in the stream), by first rank
        self.segments: dict[int, list[tuple[int, int, int, int, int, int]]] = {k: [] for k in left}
        self.sequences = position = 0

        def take(k: int, copies: int, times: int, offset: int, ids: int) -> None:
            nonlocal position
            self.segments[k].append((used[k], copies, offset, self.sequences, ids, position))
            position += (k - ids) * copies * times
            used[k] += copies * times
            left[k] -= copies * times
            if not left[k]:
                del left[k]

        while left:
            length = max(left)
            others = {k: v - (k == length) for k, v in left.items() if k <= window - length and v > (k == length)}
            fill = best_fill(others, window - length)
            fill[length] = fill.get(length, 0) + 1
            slack = window - sum(k * v for k, v in fill.items())
            donor = max((k for k, v in left.items() if v > fill.get(k, 0)), default=0) if slack else 0
            if slack and not donor:  # all that is left is in this window
                for k, v in sorted(fill.items(), reverse=True):
                    take(k, v, 1, 0, 0)
                continue
            times, offset = min(left[k] // (v + (k == donor)) for k, v in (fill | {donor: fill.get(donor, 0)} if donor else fill).items()), 0
            for k, v in sorted(fill.items(), reverse=True):
                take(k, v, times, offset, k)
                offset += k * v
            if donor:
                take(donor, 1, times, offset, slack)
            self.sequences += times
        self.stream_base = self.sequences
        last = position // window * window
        #: where the stream is cut past its last whole window
        self.cuts, at = [last], last
        while at < position:
            at += 1 << (position - at).bit_length() - 1
            self.cuts.append(at)
        self.sequences += position // window + len(self.cuts) - 1

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, sequence, offset) of the remaining tokens."""
        known = self.segments[length]
        first, copies, offset, sequence, ids, position = known[bisect_right(known, rank, key=lambda s: s[0]) - 1]
        k = rank - first
        out = [(0, ids, sequence + k // copies, offset + k % copies * ids)] if ids else []
        at = position + k * (length - ids)
        begin, end = at - ids, at + length - ids
        while at < end:
            if at >= self.cuts[0]:
                i = bisect_right(self.cuts, at) - 1
                stop, sequence, origin = self.cuts[i + 1], self.stream_base + self.cuts[0] // self.window + i, self.cuts[i]
            else:
                i = at // self.window
                stop, sequence, origin = (i + 1) * self.window, self.stream_base + i, i * self.window
            stop = min(stop, end)
            out.append((at - begin, stop - at, sequence, at - origin))
            at = stop
        return out


def _cut(plan: Plan):
    window = plan.window

    def run(batches):
        from zlib import crc32

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for doc, tokens, full, rest, length, rank, base in zip(c["doc_id"], c["doc_tokens"], c["full_crcs"], c["rest"], c["remaining"], c["rank"], c["full_base"], strict=True):
                for i, crc in enumerate(full):
                    for col, v in zip(out, (doc, i * window, window, crc, tokens, plan.sequences + base + i, 0), strict=True):
                        col.append(v)
                if length:
                    ids = np.frombuffer(rest, f"<u{len(rest) // length}").astype("<u4").tobytes()
                    for start, n, sequence, offset in plan.place(length, rank):
                        for col, v in zip(out, (doc, len(full) * window + start, n, crc32(ids[4 * start : 4 * (start + n)]), tokens, sequence, offset), strict=True):
                            col.append(v)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, *, window: int = 1024, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of a document.

    Every id of every row of docs (doc_id, text, ...) lies in one piece; sequences hold `window`
    ids, but for the powers of two of the last one cut from the stream. A null text counts as
    empty and is the end id alone. Rows that repeat a doc_id are packed as documents of their own.
    Ties of rank are settled by doc_id and the ids' CRC; rows that tie there are equal. An empty
    table gives no rows; other columns are ignored. Memory: the batch at hand and the plan, which
    holds at most `window` lengths.
    """
    docs = pick(docs, "doc_id", "text")
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = written(docs.mapInArrow(_tokenize(tokenizer_path, end_id, window), "doc_id bigint, doc_tokens bigint, crc bigint, full_crcs array<bigint>, rest binary"), "tokens")
    tokens = tokens.withColumn("remaining", F.col("doc_tokens") % window).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(buckets)))
    key = ["remaining", "bucket"]
    whole = F.size("full_crcs").cast("long")
    sums = written(tokens.groupBy(key).agg(F.count("*").alias("n"), F.sum(whole).alias("f")), "sums")
    lengths = {r["remaining"]: (r["n"], r["f"]) for r in sums.groupBy("remaining").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect()}
    plan = Plan({k: n for k, (n, _) in lengths.items()}, window)
    first, at = {}, 0
    for k in sorted(lengths):
        first[k], at = at, at + lengths[k][1]
    base = F.create_map(*(F.lit(int(x)) for kv in first.items() for x in kv))[F.col("remaining").cast("int")] if first else F.lit(0)
    earlier = Window.partitionBy("remaining").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), (F.coalesce(F.sum("f").over(earlier), F.lit(0)) + base).alias("f0"))
    own = Window.partitionBy(*key).orderBy("doc_id", "crc")
    ranked = tokens.withColumn("r", F.row_number().over(own) - 1).withColumn("g", F.coalesce(F.sum(whole).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(offsets, key).select("doc_id", "doc_tokens", "full_crcs", "rest", "remaining", (F.col("n0") + F.col("r")).alias("rank"), (F.col("f0") + F.col("g")).alias("full_base"))
    return ranked.mapInArrow(_cut(plan), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
