"""Quality rules: base counts of each text, and n-gram perplexity under a modified Kneser-Ney model.

The tokens of the model are code points (those past 65535 are folded into 16 bits), so an n-gram
of four fits a 64-bit key exactly and the vocabulary stays small. Spark counts the n-grams of all
documents by language, each task summing its own first; discounts, context sums and the
interpolated probabilities of all four orders are joins and sums over the distinct n-grams, and
the number of distinct n-grams a language has grows with its input. Perplexity is a word's: the
n-grams' log-probabilities over the number of words, so that marks strung to words count. The model is one table
(lang, key, logp). While it has at most `broadcast_ngrams` rows it is sent to the tasks as sorted
key arrays; beyond that the n-grams of each text, counted, are joined with the table, the commonest
by broadcast.

A document is kept if its log perplexities, a word's and a code point's, both lie between their
language's bands: `bands` and `char_bands` robust standard deviations (quartile range / 1.349) around the median of all documents of the language
that pass the base rules, wider for short texts, whose perplexity varies more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, checked_small, documents, hot_join, mix, text_pieces, written

ORDER, WORDS = 4, 8
#: Code points whose n-grams a task holds at once, distinct n-grams it sums before handing them on, and rows it hands on at a time.
PIECE, HELD, OUT_ROWS = 500_000, 500_000, 100_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def ngram_keys(text: bytes) -> np.ndarray:
    """The text's n-grams in order, four code points a key."""
    x = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(x) < ORDER:
        return x[:0]
    x = (x ^ (x >> np.uint64(16))) & np.uint64(0xFFFF)
    pair = (x[:-1] << np.uint64(16)) | x[1:]
    return (pair[:-2] << np.uint64(32)) | pair[2:]


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if counts is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _count(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held[lang] = [(keys, counts)]
        return sum(len(p[0][0]) for p in held.values())

    def rows():
        for lang, parts in held.items():
            for keys, counts in parts:
                for at in range(0, len(keys), OUT_ROWS):
                    own = keys[at : at + OUT_ROWS]
                    yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(own.view(np.int64)), pa.array(counts[at : at + OUT_ROWS].astype(np.int64))], names=["lang", "key", "a"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, texts in text_pieces(batch.column(0), PIECE):
            by: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                by.setdefault(lang, []).append(ngram_keys(t))
            for lang, parts in by.items():
                keys, counts = _summed(np.concatenate(parts))
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
            if size > 2 * HELD:
                size = flush()
                if size > HELD:  # hand on what there is, so that memory stays bounded
                    yield from rows()
                    held.clear()
                    size = 0
    flush()
    yield from rows()


def ngram_model(docs: DataFrame) -> DataFrame:
    """(lang, key, logp, a) for each n-gram of docs (text, lang): interpolated modified Kneser-Ney; a: its count."""
    counts = docs.mapInArrow(_count, "lang string, key bigint, a bigint").groupBy("lang", "key").agg(F.sum("a").alias("a"))
    orders = {ORDER: written(counts, "ngrams")}
    for m in range(ORDER - 1, 0, -1):
        below = F.col("key").bitwiseAND(F.lit((1 << (16 * m)) - 1))
        orders[m] = written(orders[m + 1].select("lang", below.alias("key")).groupBy("lang", "key").agg(F.count("*").alias("a")), "ngrams")
    lower = None
    for m in range(1, ORDER + 1):
        t = orders[m]
        n1, n2, n3, n4 = (F.count_if(F.col("a") == i).cast("double") for i in range(1, 5))
        found = t.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"), F.count("*").alias("types"))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        d = [F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)), F.lit(0.1)), F.lit(i - 0.1))).otherwise(F.lit(0.6 * i)) for i in (1, 2, 3)]
        found = checked_small(found.select("lang", "types", *(x.alias(f"d{i}") for i, x in enumerate(d, 1))))
        discount = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(found, "lang").withColumn("d", F.least(discount, F.col("a").cast("double"))).withColumn("context", F.shiftrightunsigned("key", 16) if m > 1 else F.lit(0).cast("long"))
        sums = t.groupBy("lang", "context").agg(F.sum("a").alias("s"), F.sum("d").alias("freed"))
        t = t.join(sums, ["lang", "context"])
        if lower is None:
            p = (F.col("a") - F.col("d")) / F.col("s") + F.col("freed") / F.col("s") / (F.col("types") + 1)
            lower = t.select("lang", "key", p.alias("p"))
        else:
            t = t.withColumn("below", F.col("key").bitwiseAND(F.lit((1 << (16 * (m - 1))) - 1)))
            t = t.join(lower.select("lang", F.col("key").alias("below"), F.col("p").alias("q")), ["lang", "below"])
            lower = t.select("lang", "key", ((F.col("a") - F.col("d")) / F.col("s") + F.col("freed") / F.col("s") * F.col("q")).alias("p"), "a")
    return lower.select("lang", "key", F.log("p").cast("float").alias("logp"), "a")


def repeated_window_words(words: np.ndarray, size: int = WORDS) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    if len(words) <= size:
        return 0
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = mix(h ^ words[j : j + len(h)]) + GOLDEN
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    np.subtract.at(cover, at + size, 1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def _base(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    words = text.split()
    b = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~_SPACE[b]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, int(np.count_nonzero(_SYMBOL[b])), len(lines) - len(set(lines)), repeated_window_words(hashes.of(words))


def _score(shared):
    """(doc_id, text, lang) -> base counts, number of n-grams, and their log-probability if a model is given."""

    def run(batches):
        hashes = WordHashes()
        model = shared.value if shared is not None else {}
        for batch in batches:
            rows, langs = [], batch.column(2).to_pylist()
            for at, texts in text_pieces(batch.column(1), PIECE):
                for t, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                    keys = ngram_keys(t)
                    total = None
                    if lang in model and len(keys):
                        known, logp = model[lang]
                        total = float(logp[np.minimum(np.searchsorted(known, keys), len(known) - 1)].sum(dtype=np.float64))
                    rows.append((*_base(t, hashes), len(keys), total))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())], names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "logp"])

    return run


_SCORED = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, logp double"


def _gram_rows(batches):
    """(row, text, lang) -> (row, lang, key, times)."""
    for batch in batches:
        texts = (t for _, some in text_pieces(batch.column(1), PIECE) for t in some)
        for row, t, lang in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
            keys, times = _summed(ngram_keys(t))
            yield pa.record_batch([pa.array([row] * len(keys), pa.int64()), pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(times, pa.int64())], names=["row", "lang", "key", "times"])


def _sent(model: DataFrame):
    """The model as sorted arrays, broadcast to the tasks."""
    arrow = model.drop("a").toArrow()
    codes = arrow.column("lang").combine_chunks().dictionary_encode()
    keys, logp = arrow.column("key").to_numpy().view(np.uint64), arrow.column("logp").to_numpy()
    out = {}
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        own = np.flatnonzero(codes.indices.to_numpy() == code)
        order = own[np.argsort(keys[own])]
        out[lang] = (keys[order], logp[order])
    return model.sparkSession.sparkContext.broadcast(out)


def perplexities(docs: DataFrame, *, broadcast_ngrams: int = 4_000_000) -> DataFrame:
    """Base counts and log_ppl (a word's; null for texts without words or under four code points) of each row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"))
    model = written(ngram_model(docs.select("text", "lang")), "model")
    if model.limit(broadcast_ngrams + 1).count() <= broadcast_ngrams:
        scored = docs.mapInArrow(_score(_sent(model)), _SCORED)
    else:
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        grams = docs.select("row", "text", "lang").mapInArrow(_gram_rows, "row bigint, lang string, key bigint, times bigint")
        # an n-gram has no more rows than it has occurrences
        ngram = F.struct("lang", "key").alias("ngram")
        sums = hot_join(grams.select("row", ngram, "times"), model.select(ngram, "logp", "a"), "ngram", "a").groupBy("row").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("total"))
        base = docs.select("row", "text", "lang").mapInArrow(_score(None), _SCORED).drop("logp").withColumnRenamed("doc_id", "row")
        scored = base.join(sums, "row", "left").join(docs.select("row", "doc_id"), "row").withColumn("logp", F.col("total")).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "logp")
    return scored.withColumn("log_ppl", F.when((F.col("n_grams") > 0) & (F.col("n_words") > 0), -F.col("logp") / F.col("n_words"))).withColumn("log_ppl_char", F.when(F.col("n_grams") > 0, -F.col("logp") / F.col("n_grams"))).drop("logp")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(docs: DataFrame, *, bands: float = 6.0, char_bands: float = 4.0, short: int = 1500, **more) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, log_ppl_char, lang.

    Words are runs of anything but ASCII white space. A null or empty text has no words and fails
    the base rules; a null lang is a language of its own; without a perplexity the base rules
    decide; repeated rows give repeated rows; an empty table none; other columns are ignored. A
    text of n n-grams has bands wider by sqrt(1 + short / n). Memory: a batch of texts, and the
    model only where it is small.
    """
    scored = written(perplexities(docs, **more).withColumn("base_failed", base_failed()), "scored")
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(f"q_{c}")
    usual = scored.where("not base_failed and log_ppl is not null").groupBy("lang").agg(quartiles("log_ppl"), quartiles("log_ppl_char"))
    scored = scored.join(checked_small(usual), "lang", "left")

    def inside(column: str, width: float) -> Column:
        low, middle, high = (F.col(f"q_{column}")[i] for i in range(3))
        spread = F.greatest((high - low) / 1.349, F.lit(0.01))
        return F.coalesce(F.abs(F.col(column) - middle) <= width * spread * F.sqrt(1 + short / F.greatest(F.col("n_grams"), F.lit(1))), F.lit(True))

    scored = scored.withColumn("lang", F.when(F.col("lang") != "", F.expr("substring(lang, 2)")))
    out = scored.withColumn("kept", ~F.col("base_failed") & inside("log_ppl", bands) & inside("log_ppl_char", char_bands))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "log_ppl_char", "lang")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
