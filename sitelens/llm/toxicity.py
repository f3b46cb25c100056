"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary documents, count in how many documents of
their class a word follows another. Each is an interpolated modified Kneser-Ney model of its own
counts: discounted counts over the class's total of the context word, the freed mass going to the
class's continuation counts, and theirs to continuation counts that both classes share. The
discounts come from the shared counts and are taken from both classes in proportion, and every
expression has a few backoff counts (`shared` a word, `shared_pairs` a pair) that the classes
share as the next shorter expression says, so that an expression too rare to say anything about a
class says no more than its parts. A token's evidence is the
difference of the two log-likelihoods; a text's features are the difference's mean over its tokens
(the length-normalised log-likelihoods compared) and its largest value at a token, and a logistic
calibration, fitted on a fold of labelled rows that gave no counts, turns them into a score.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, crc_fold, documents, dropped, mix, pick, small_enough, swept, text_bytes, text_pieces, written
from .learn import fit_logistic_table, labelled_ids

#: What stands before the first word of a text.
START = np.uint64(1)
FEATURES = 2
#: Pairs of minwise bigrams by which near copies of a training text are looked up.
BANDS = 16
#: Sums of fractions are sums of this many parts of one, so that their order changes nothing.
PARTS = 2**32
#: A token's evidence is a multiple of one part of these, so that sums are the same in any order.
GRID = 2.0**24
#: Rows of the models that the driver holds at once.
PART_ROWS = 1_000_000
#: Parts after which the driver lets go of what their way through it left.
SWEEP_PARTS = 4
#: Words whose table is broadcast, and the parts, by context, in which pairs are joined with larger ones.
FEW_WORDS, SLICES = 200_000, 4
#: Rows of the words and contexts of a model that are sent, rows of pairs in a bucket, and characters of the texts that ask a bucket at once.
VOCABULARY_ROWS, BUCKET_ROWS, ASK_CHARS = 16_000_000, 4_000_000, 1_000_000
_TOKEN = rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and other characters past ASCII."""
    import re

    return re.findall(_TOKEN, text.decode("utf-8", "replace").lower().encode("utf-8", "replace"))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * GOLDEN + np.uint64(1)) ^ words


def bigrams(words: np.ndarray) -> np.ndarray:
    """A key for each word with the one before it."""
    return pair_keys(words[:-1], words[1:])


def _started(words: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], words])


def _count(batches):
    """(text, y) -> (key, before, word, n0, n1): in how many texts of each class the pair stands."""
    hashes = WordHashes()
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for at, texts in text_pieces(batch.column(0)):
            found: list[np.ndarray] = []
            for t, y in zip(texts, labels[at : at + len(texts)], strict=True):
                words = _started(hashes.of(tokens(t)))
                keys, first = np.unique(bigrams(words), return_index=True)
                found.append(np.stack([keys, words[:-1][first], words[1:][first], np.full(len(keys), int(y > 0), np.uint64)]))
            keys, before, word, y = np.concatenate(found, axis=1)
            keys, first, each = np.unique(keys, return_index=True, return_inverse=True)
            ones = np.bincount(each, y == 1, len(keys)).astype(np.int64)
            n = np.bincount(each, minlength=len(keys)).astype(np.int64)
            yield pa.record_batch([pa.array(a.view(np.int64)) for a in (keys, before[first], word[first], n - ones, ones)], names=["key", "before", "word", "n0", "n1"])


def _set(words: np.ndarray) -> np.ndarray:
    return np.unique(bigrams(words) if len(words) > 1 else words)


def _near(percent: int):
    """(id, text, to_text) -> the ids of those whose bigram sets are close enough."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids = []
            for i, *texts in zip(batch.column(0).to_pylist(), *(text_bytes(batch.column(c)) for c in (1, 2)), strict=True):
                a, b = (_set(hashes.of(tokens(t))) for t in texts)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    ids.append(i)
            yield pa.record_batch([pa.array(ids, pa.int64())], names=["id"])

    return run


def _normal(batches):
    """(text, y) -> id (of its tokens and label), text of its tokens, y, hashes of pairs of minwise bigrams."""
    hashes, salts = WordHashes(), np.arange(2 * BANDS, dtype=np.uint64) * GOLDEN
    for batch in batches:
        texts, ids, bands = [], [], []
        for t, y in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = tokens(t)
            w, label = hashes.of(found), np.uint64(y > 0)
            own = _set(w)
            marks = np.array([mix(own + salt).min() if len(own) else 0 for salt in salts], np.uint64)
            bands.append((mix(marks[::2] * GOLDEN + label) ^ mix(marks[1::2] + np.arange(BANDS, dtype=np.uint64))).view(np.int64).tolist())
            texts.append(b" ".join(found).decode("utf-8", "replace"))
            ids.append(int(np.uint64(hashes.digest(texts[-1].encode(), seed=int(label))).view(np.int64)))
        types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array(x, t) for x, t in zip((ids, texts, batch.column(1).to_pylist(), bands), types, strict=True)], names=["id", "text", "y", "bands"])


def without_copies(rows: DataFrame, percent: int = 80) -> DataFrame:
    """(text, y) of labelled rows, text as its tokens: copies (equal tokens) and near copies of one label once.

    A row goes as a near copy only if the bigram sets of it and of a row of its label with a smaller
    id have that Jaccard, in full. Candidates are the first rows of the bands it is in.
    """
    rows = rows.select("text", "y").mapInArrow(_normal, "id bigint, text string, y int, bands array<bigint>")
    rows = written(rows.dropDuplicates(["id"]), "counted", tidy=True)
    bands = rows.select("id", F.explode("bands").alias("band"))
    pairs = written(bands.join(bands.groupBy("band").agg(F.min("id").alias("to")), "band").where("to < id").select("id", "to").distinct(), "candidates", tidy=True)
    # only texts of candidates are dealt out
    wanted = written(pairs.select("to").distinct(), "wanted")
    first = rows.select(F.col("id").alias("to"), F.col("text").alias("to_text")).join(small_enough(wanted), "to", "left_semi")
    both = rows.select("id", "text").join(small_enough(pairs), "id").join(first, "to")
    copies = written(both.select("id", "text", "to_text").mapInArrow(_near(percent), "id bigint").distinct(), "copies", tidy=True)
    dropped(pairs, wanted)
    return rows.join(small_enough(copies), "id", "left_anti").select("text", "y")


def discounts(counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of 1, 2 and more, from the numbers of expressions counted 1, 2, 3 and 4 times."""
    n = [max(c, 1) for c in counts]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.05) for i in (1, 2, 3)]


def _discounted(rows: DataFrame, n: Column, classes: list[Column]) -> tuple[list[Column], list[Column]]:
    """What each class's count loses and what is left of it; n: the shared count that the discounts are for."""
    ones = rows.agg(*(F.count_if(n == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    d = discounts([int(x) for x in ones])
    share = F.when(n == 1, d[0]).when(n == 2, d[1] / 2).otherwise(d[2] / F.greatest(n, F.lit(3)))
    return [c * share for c in classes], [c * (1 - share) for c in classes]


def _parts(x: Column) -> Column:
    """The sum of fractions x, the same in whatever order they come."""
    return F.sum(F.round(x * PARTS).cast("long")) / PARTS


def class_models(counted: DataFrame, shared: float = 4.0, shared_pairs: float = 10.0) -> DataFrame:
    """(kind, key, ratio): log P(toxic model) - log P(ordinary model) from (key, before, word, n0, n1).

    Kind 2: a known pair, P(word | before). Kind 1: a known word by its continuation counts. Kind
    0: of a context, the weights with which the class models back off from it. Kind 3, one row:
    a word that no training text holds.
    """
    both = ("n0", "n1")
    # a pair's key follows from its words, so that only these are dealt out and kept
    pairs = written(counted.groupBy("before", "word").agg(*(F.sum(c).cast("int").alias(c) for c in both)), "pairs", tidy=True)
    # continuation counts: after how many words a word stands, in each class and at all
    counts = written(pairs.groupBy("word").agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"), F.count("*").alias("n")), "words", tidy=True)
    n = F.col("n0") + F.col("n1")
    lost, left = _discounted(counts, n, [F.col(c) for c in both])
    lost_n, left_n = _discounted(counts, F.col("n"), [F.col("n")])
    sums = counts.agg(*(F.sum(c).cast("double").alias(c) for c in (*both, "n")), *(_parts(x).alias(f"freed{i}") for i, x in enumerate([*lost, *lost_n])), F.count("*").alias("known")).first()
    known = sums["known"]
    total, freed = [sums[c] or 0.0 for c in both], [sums[f"freed{i}"] or 0.0 for i in (0, 1)]
    size = [t / max(sum(total), 1.0) for t in total]
    rare = (sums["freed2"] or 0.0) / max(sums["n"] or 0.0, 1.0) / (known + 1)
    scale = [max(total[c] + shared * size[c] * known, 1e-9) for c in (0, 1)]
    lower = left_n[0] / max(sums["n"] or 0.0, 1.0) + rare
    words = written(counts.select("word", *(((left[c] + shared * size[c] + freed[c] * lower) / scale[c]).alias(f"p{c}") for c in (0, 1))), "words")
    unknown = [max(freed[c] * rare / scale[c], 1e-300) for c in (0, 1)]

    lost, left = _discounted(pairs, n, [F.col(c) for c in both])
    all_pairs = pairs.agg(*(F.sum(c).cast("double").alias(c) for c in both)).first()
    size = [(x or 0.0) / max((all_pairs[0] or 0.0) + (all_pairs[1] or 0.0), 1.0) for x in all_pairs]
    contexts = pairs.groupBy("before").agg(*(F.sum(c).alias(f"c{i}") for i, c in enumerate(both)), *(_parts(x).alias(f"f{i}") for i, x in enumerate(lost)))
    portion = lambda c: (F.col(f"c{c}") + shared * size[c]) / (F.col("c0") + F.col("c1") + shared)
    contexts = contexts.select("before", *(portion(c).alias(f"m{c}") for c in (0, 1)), *((F.col(f"f{c}") + portion(c) * shared).alias(f"b{c}") for c in (0, 1)), *((F.col(f"c{c}") + portion(c) * shared).alias(f"z{c}") for c in (0, 1)))
    first = written(contexts, "contexts", tidy=True)
    # a pair's backoff counts go to the classes as its context and its word do
    weight = [F.col(f"m{c}") * F.col(f"p{c}") for c in (0, 1)]
    own = [shared_pairs * weight[c] / (weight[0] + weight[1]) for c in (0, 1)]
    slices = SLICES if known > FEW_WORDS else 1

    def known_pairs(i: int, contexts: DataFrame) -> DataFrame:
        of_slice = lambda rows: rows.where(F.pmod(F.xxhash64("before"), F.lit(slices)) == i)
        return of_slice(pairs).join(small_enough(words, FEW_WORDS), "word").join(small_enough(of_slice(contexts), FEW_WORDS), "before")

    def by_slices(rows: Callable[[int], DataFrame], tag: str) -> DataFrame:
        """rows(i) of all slices, written one after another, so that little is dealt out at a time."""
        return functools.reduce(DataFrame.unionByName, [written(rows(i), tag, tidy=True) for i in range(slices)])

    more = by_slices(lambda i: known_pairs(i, first.select("before", "m0", "m1")).groupBy("before").agg(*(_parts(own[c]).alias(f"s{c}") for c in (0, 1))), "more")
    contexts = written(first.join(more, "before").select("before", "m0", "m1", "b0", "b1", *((F.col(f"z{c}") + F.col(f"s{c}")).alias(f"z{c}") for c in (0, 1))), "contexts", tidy=True)
    some = lambda c: F.greatest(F.col(f"z{c}"), F.lit(1e-9))
    p = [(left[c] + own[c] + F.col(f"b{c}") * F.col(f"p{c}")) / some(c) for c in (0, 1)]
    ratio = lambda one, zero: F.log(F.greatest(one, F.lit(1e-300)) / F.greatest(zero, F.lit(1e-300))).cast("float").alias("ratio")
    row = lambda rows, kind, key, one, zero: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), ratio(one, zero))
    out = by_slices(lambda i: known_pairs(i, contexts).select("before", "word", ratio(p[1], p[0])).mapInArrow(_keyed, "kind int, key bigint, ratio float"), "ratios")
    rest = row(words, 1, "word", F.col("p1"), F.col("p0")).unionByName(row(contexts, 0, "before", F.col("b1") / some(1), F.col("b0") / some(0)))
    last = counted.sparkSession.range(1).select(F.lit(3).alias("kind"), F.col("id").alias("key"), F.lit(float(np.log(unknown[1] / unknown[0]))).cast("float").alias("ratio"))
    rest = written(rest.unionByName(last), "ratios", tidy=True)
    dropped(pairs, counts, words, first, more, contexts)
    return out.unionByName(rest)


def _keyed(batches):
    """(before, word, ratio) of pairs -> (kind, key, ratio)."""
    for batch in batches:
        before, word = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        yield pa.record_batch([pa.array(np.full(len(word), 2, np.int32)), pa.array(pair_keys(before, word).view(np.int64)), batch.column(2)], names=["kind", "key", "ratio"])


class Evidence:
    """The rows of class_models(), or parts of them by key(), as arrays sorted by key."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, ratio: np.ndarray):
        self.tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for k in (0, 1, 2):
            own = np.flatnonzero(kind == k)
            keys = key[own].view(np.uint64)
            order = np.argsort(keys)
            self.tables.append([(keys[order], ratio[own][order].astype(np.float32))] if len(own) else [])
        unknown = ratio[kind == 3]
        self.unknown = float(unknown[0]) if len(unknown) else 0.0

    @classmethod
    def together(cls, parts: list[Evidence]) -> Evidence:
        """One of several that each have other rows; nothing is copied."""
        out = cls.__new__(cls)
        out.tables = [[t for p in parts for t in p.tables[k]] for k in (0, 1, 2)]
        out.unknown = sum(p.unknown for p in parts)
        return out

    def _of(self, kind: int, wanted: np.ndarray, default: np.ndarray | float) -> np.ndarray:
        out = np.zeros(len(wanted)) + default
        order = np.argsort(wanted)  # in order, so that the search stays in nearby memory
        ordered = wanted[order]
        for keys, values in self.tables[kind]:
            some = slice(np.searchsorted(ordered, keys[0]), np.searchsorted(ordered, keys[-1], "right"))
            at = np.searchsorted(keys, ordered[some])
            known = keys[at] == ordered[some]
            out[order[some][known]] = values[at[known]]
        return out

    def ratios(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(token | before, toxic) - log P(token | before, ordinary) of each token."""
        out = self._of(2, pair_keys(before, words), np.nan)
        rest = np.flatnonzero(np.isnan(out))  # pairs that no training text holds
        out[rest] = self._of(1, words[rest], self.unknown) + self._of(0, before[rest], 0.0)
        return np.rint(out * GRID) / GRID

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text, the difference's mean over its tokens and its largest value; 0 without tokens."""
        sizes = np.array([len(t) for t in texts], np.int64)
        starts, some = np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes > 0
        out = np.zeros((len(texts), FEATURES))
        if some.any():
            words = np.concatenate(texts)
            before = np.concatenate([[START], words[:-1]])
            before[starts[some]] = START
            r = self.ratios(words, before)
            out[some, 0] = np.add.reduceat(r, starts[some]) / sizes[some]
            out[some, 1] = np.maximum.reduceat(r, starts[some])
        return out


def _features(shared: list):
    """(..., text) -> (..., x0, x1); shared: broadcasts of Evidence."""

    def run(batches):
        evidence, hashes = Evidence.together([b.value for b in shared]), WordHashes(200_000)
        for batch in batches:
            *kept, _ = batch.schema.names
            for at, texts in text_pieces(batch.column(len(kept)), 1_000_000):
                rows = evidence.features([hashes.of(tokens(t)) for t in texts])
                yield pa.record_batch([*(batch.column(i).slice(at, len(texts)) for i in range(len(kept))), *(pa.array(rows[:, i]) for i in range(FEATURES))], names=[*kept, "x0", "x1"])

    return run


def _pair_rows(batches):
    """(row, text) -> (row, key, before, word, times) of each text's distinct pairs."""
    hashes = WordHashes()
    for batch in batches:
        for at, texts in text_pieces(batch.column(1)):
            for i, t in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                words = _started(hashes.of(tokens(t)))
                keys, first, times = np.unique(bigrams(words), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(keys), i, np.int64)), *(pa.array(a.view(np.int64)) for a in (keys, words[:-1][first], words[1:][first], times))], names=["__row", "key", "before", "word", "times"])


#: Packed arrays that go to a bucket: keys (8 bytes) and ratios of a part of the model, or the pairs of some texts as numbers of words.
_PACKED = "bucket int, asked boolean, ids array<bigint>, sizes array<int>, a binary, b binary, times binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "asked", "ids", "sizes", "a", "b", "times"])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed: first bytes of all, second bytes of all, ..."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unsqueezed(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4")[:, 0]


def _ranges(keys: np.ndarray, bits: int):
    """(bucket, places) of keys by their first bits."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    order = np.argsort(buckets, kind="stable")
    ends = np.flatnonzero(np.diff(buckets[order])) + 1
    for places in np.split(order, ends) if len(keys) else ():
        yield int(buckets[places[0]]), places


def _offered(bits: int):
    """(key, ratio) of known pairs -> _PACKED."""

    def run(batches):
        for batch in batches:
            keys, ratios = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if len(keys):
                yield _packed([(i, False, [], [], keys[at].tobytes(), ratios[at].tobytes(), b"") for i, at in _ranges(keys, bits)])

    return run


def _asked(shared: list, bits: int):
    """(row, text) -> _PACKED: the distinct pairs of each text, as numbers of the words in the tables of shared (Vocabulary); each pair goes to one bucket."""

    def run(batches):
        vocabulary, hashes = Vocabulary([b.value for b in shared]), WordHashes(200_000)
        for batch in batches:
            for at, texts in text_pieces(batch.column(1), ASK_CHARS):
                ids = batch.column(0).slice(at, len(texts)).to_numpy()
                found: list[tuple[np.ndarray, ...]] = []
                for i, t in enumerate(texts):
                    words = _started(hashes.of(tokens(t)))
                    keys, first, times = np.unique(bigrams(words), return_index=True, return_counts=True)
                    found.append((keys, words[:-1][first], words[1:][first], times, np.full(len(keys), i)))
                keys, before, word, times, text = (np.concatenate(x) for x in zip(*found, strict=True))
                before, word = vocabulary.numbers(before), vocabulary.numbers(word)
                rows = []
                for i, places in _ranges(keys, bits):
                    own, sizes = np.unique(text[places], return_counts=True)  # places go up, so texts stay together
                    rows.append((i, True, ids[own].tolist(), sizes.tolist(), _squeezed(word[places]), _squeezed(before[places]), _squeezed(times[places])))
                if rows:
                    yield _packed(rows)

    return run


def _answered(shared: list):
    """_PACKED, each bucket's part of the model before the pairs asked for -> (row, total, n, most): sums over a text's pairs of the bucket, and the largest ratio."""

    def run(batches):
        vocabulary = Vocabulary([b.value for b in shared])
        bucket, parts, table = None, [], None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                at, asked, ids, sizes, a, b, times = (batch.column(c)[i] for c in range(7))
                if at.as_py() != bucket:
                    bucket, parts, table = at.as_py(), [], None
                a, b = a.as_py(), b.as_py()
                if not asked.as_py():
                    parts.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.float32)))
                    continue
                if table is None:
                    keys, ratios = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.float32))
                    table, parts = Evidence(np.full(len(keys), 2, np.int32), keys.view(np.int64), ratios), []
                sizes = sizes.values.to_numpy()
                word, before, times = (_unsqueezed(x, int(sizes.sum())) for x in (a, b, times.as_py()))
                r = vocabulary.ratios(table, word, before)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                out.append((ids.values.to_numpy(), np.add.reduceat(r * times, starts), np.add.reduceat(times.astype(np.int64), starts), np.maximum.reduceat(r, starts)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["__row", "total", "n", "most"])

    return run


class Vocabulary:
    """All words and contexts of a model, numbered; the number after the last stands for what no training text holds."""

    def __init__(self, parts: list[Evidence]):
        both = Evidence.together(parts)
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *(t[0] for k in (0, 1) for t in both.tables[k])]))
        self.word = np.append(both._of(1, self.keys, both.unknown), both.unknown)
        self.context = np.append(both._of(0, self.keys, 0.0), 0.0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes).astype(np.uint32)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        at[~known] = len(self.keys)
        return at

    def ratios(self, pairs: Evidence, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """As Evidence.ratios(), of numbered words."""
        out, n = np.full(len(word), np.nan), len(self.keys)
        known = np.flatnonzero((word < n) & (before < n))
        out[known] = pairs._of(2, pair_keys(self.keys[before[known]], self.keys[word[known]]), np.nan)
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = self.word[word[rest]] + self.context[before[rest]]
        return np.rint(out * GRID) / GRID


def sent(model: DataFrame, n: int) -> list:
    """The n rows of class_models() as broadcasts of Evidence of about PART_ROWS rows at most, by ranges of key; the driver holds one at a time."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / PART_ROWS)))
    out = []
    for i in range(2**bits):
        own = model.where(F.shiftrightunsigned("key", 64 - bits) == i) if bits else model
        arrow = own.toArrow()
        out.append(model.sparkSession.sparkContext.broadcast(Evidence(*(arrow.column(c).to_numpy() for c in ("kind", "key", "ratio")))))
        del arrow
        if i % SWEEP_PARTS == SWEEP_PARTS - 1:
            swept(model.sparkSession)
    return out


def featured(model: DataFrame, broadcast_rows: int = 16_000_000) -> tuple[Callable[[DataFrame], DataFrame], Callable[[], None]]:
    """Of a table with a text, all other columns and the text's features x0, x1, by the rows of class_models(); and what to call once all such tables are written.

    A model of at most `broadcast_rows` is sent to the tasks and its table deleted; beyond, only its
    words are, and the distinct pairs of each text are dealt out once, as packed numbers of words, to
    the parts of the model that know them (with over VOCABULARY_ROWS words: joined, a row a pair).
    The features are the same: ratios are multiples of 1 / GRID, so that
    their sums are exact. The call at the end frees the model: a table that isn't written would hold
    its broadcasts in the driver for as long as anybody holds the table.
    """
    n = model.count()
    others = lambda rows: [f"`{c}`" for c in rows.columns if c != "text"]
    if n <= broadcast_rows:
        swept(model.sparkSession)
        shared = sent(model, n)
        dropped(model)
        swept(model.sparkSession)

        def by_broadcast(rows: DataFrame) -> DataFrame:
            kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
            return rows.select(*others(rows), "text").mapInArrow(_features(shared), f"{kinds}x0 double, x1 double")

        def destroyed() -> None:
            for b in shared:
                b.destroy()

        return by_broadcast, destroyed
    rest = written(model.where("kind <> 2"), "vocabulary")
    m = rest.count()
    if m <= VOCABULARY_ROWS:
        swept(model.sparkSession)
        shared, bits = sent(rest, m), max(0, math.ceil(math.log2(max(n - m, 1) / BUCKET_ROWS)))

        def by_buckets(rows: DataFrame) -> DataFrame:
            # equal texts have equal features: a text's hash stands for it, so that no text is written or dealt out
            rows = rows.withColumn("__row", F.xxhash64("text"))
            asked = rows.select("__row", "text").mapInArrow(_asked(shared, bits), _PACKED)
            offered = model.where("kind = 2").select("key", "ratio").mapInArrow(_offered(bits), _PACKED)
            dealt = offered.unionByName(asked).repartitionById(2**bits, F.col("bucket")).sortWithinPartitions("bucket", "asked")
            sums = dealt.mapInArrow(_answered(shared), "__row bigint, total double, n bigint, most double")
            sums = sums.groupBy("__row").agg((F.sum("total") / F.sum("n")).alias("x0"), F.max("most").alias("x1"))
            return rows.join(sums, "__row", "left").select(*others(rows.drop("__row")), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("x0", "x1")))

        def all_freed() -> None:
            for b in shared:
                b.destroy()
            dropped(model, rest)

        return by_buckets, all_freed
    unknown = (model.where("kind = 3").first() or {"ratio": 0.0})["ratio"]
    dropped(rest)
    of = lambda kind, key: model.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("ratio").cast("double").alias(f"r{kind}"))

    read = [model]

    def by_join(rows: DataFrame) -> DataFrame:
        rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
        read.append(rows)
        pairs = rows.select("__row", "text").mapInArrow(_pair_rows, "__row bigint, key bigint, before bigint, word bigint, times bigint")
        pairs = pairs.join(of(2, "key"), "key", "left").join(of(1, "word"), "word", "left").join(of(0, "before"), "before", "left")
        r = F.rint(F.coalesce("r2", F.coalesce("r1", F.lit(unknown)) + F.coalesce("r0", F.lit(0.0))) * GRID) / GRID
        sums = pairs.withColumn("r", r).groupBy("__row").agg((F.sum(F.col("r") * F.col("times")) / F.sum("times")).alias("x0"), F.max("r").alias("x1"))
        return rows.join(sums, "__row", "left").select(*others(rows.drop("__row")), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("x0", "x1")))

    return by_join, lambda: dropped(*read)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, threshold: float = 0.3, shared: float = 4.0, shared_pairs: float = 10.0, broadcast_rows: int = 16_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...).

    Learns from labels.toxic of all rows outside held_out (crc32 of doc_id modulo 4 is 2):
    remainders 0 and 1 give the counts, 3 the calibration. Null labels and labels of unknown
    documents count for nothing; with no labels, or of one class only, all scores lie near that
    class. A null or empty text has all features 0 and the score of these. A null doc_id is never
    held out. Repeated rows give repeated rows, an empty table none; other columns are ignored.
    The same rows give the same scores in whatever order or number of partitions they come. The
    models hold all n-grams of the labelled rows; they are counted, smoothed and calibrated in
    Spark. Up to `broadcast_rows` ratios go through the driver in parts of bounded size; beyond,
    the texts' pairs are dealt out to them. The features of all rows are written before this returns,
    so that the result holds no model.
    """
    docs = pick(docs, "doc_id", "text")
    fold = crc_fold("doc_id", 4)
    held_out = F.coalesce(fold == 2, F.lit(False)) if held_out is None else held_out
    ids = written(labelled_ids(docs, labels, "toxic", fold != 2), "labelled", tidy=True)
    rows = lambda folds: docs.join(small_enough(ids.where(folds)), "doc_id").select("doc_id", "text", "y")
    # copies and near copies of a text are no further evidence
    texts = without_copies(rows(fold < 2))
    model = class_models(texts.mapInArrow(_count, "key bigint, before bigint, word bigint, n0 bigint, n1 bigint"), shared, shared_pairs)
    dropped(texts)
    features, freed = featured(model, broadcast_rows)
    fit = written(features(rows(fold == 3)).select("x0", "x1", F.col("y").cast("double").alias("y")), "fit", tidy=True)
    weights = fit_logistic_table(fit.withColumn("y", F.greatest(F.least("y", F.lit(1.0)), F.lit(0.0))), ["x0", "x1"], "y")
    scored = written(features(docs), "scored", tidy=True)
    freed()
    dropped(ids, fit)
    logit = sum((F.col(f"x{i}") * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(40.0)), F.lit(-40.0))))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """docs without the documents predicted toxic; rows with a null doc_id stay."""
    toxic = toxicity_scores(docs, labels, **more).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
