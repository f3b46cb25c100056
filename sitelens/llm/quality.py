"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets features of itself and of its neighbours (shares of upper case, digits,
symbols, marks and bars, word lengths, words in four-word runs that the text repeats, equal
lines). A two-label chain (good, bad) scores the lines; forward-backward gives each line's
marginal, and the document's score is their mean weighted by line length, calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, crc_fold, documents, mix, pick, text_bytes, text_pieces
from .learn import fit_logistic, labelled_sample

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?'\"()-", b" \t\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
RUN = 4
#: Features of a line; the first NEAR of them are also taken of the lines before and after.
NEAR, OWN = 7, 12
FEATURES = OWN + 2 * NEAR


def line_features(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and each line's length in bytes plus one."""
    lines = text.split(b"\n")
    split = [x.split() for x in lines]
    n = len(lines)
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = np.concatenate([[0], ends[:-1]])
    kinds = _CLASS[np.frombuffer(text + b"\n", np.uint8)]
    share = np.stack([np.add.reduceat(kinds == k, starts) for k in range(1, 9)]).astype(float)
    upper, lower, digit, symbol, bar, bang, mark, space = share
    length = (ends - starts - 1).astype(float)
    words = np.array([len(x) for x in split], float)
    flat = hashes.of([w for x in split for w in x])
    covered = np.zeros(len(flat))
    if len(flat) >= RUN:
        h = np.zeros(len(flat) - RUN + 1, np.uint64)
        for j in range(RUN):
            h = mix(h ^ flat[j : j + len(h)]) + GOLDEN
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for j in range(RUN):
            covered[j : j + len(h)][twice] = 1
    owner = np.repeat(np.arange(n), words.astype(int))
    repeated = np.bincount(owner, covered, minlength=n)
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    equal = np.array([seen[x] > 1 and len(x) > 0 for x in lines], float)
    some, w = np.maximum(length, 1), np.maximum(words, 1)
    own = np.stack([
        upper / np.maximum(upper + lower, 1), symbol / w, bar / w, bang / w, repeated / w, digit / some, equal,
        mark / w, np.minimum(length / w, 40) / 10, np.log1p(words) / 5, space / some, np.ones(n),
    ], 1)
    own[words == 0, :-1] = 0
    before = np.vstack([np.zeros((1, NEAR)), own[:-1, :NEAR]])
    after = np.vstack([own[1:, :NEAR], np.zeros((1, NEAR))])
    return np.hstack([own, before, after]).clip(-4, 4), np.array([len(x) + 1 for x in lines], float)


def _steps(lengths: np.ndarray) -> list[np.ndarray]:
    """For each position, the documents that reach it."""
    order = np.argsort(-lengths, kind="stable")
    return [order[: np.searchsorted(-lengths[order], -p, side="left")] for p in range(int(lengths.max(initial=0)))]


def chain_marginals(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Log-odds of label 1 for every line by forward-backward; with pairs, the expected label pairs too.

    scores: log-odds of each line alone, documents one after another; trans[i, j]: score of label j after i.
    """
    forward, back = scores.copy(), np.zeros_like(scores)
    steps = _steps(lengths)
    lse = np.logaddexp
    for p in range(1, len(steps)):
        at = starts[steps[p]] + p
        a = forward[at - 1]
        forward[at] += lse(trans[1, 1] + a, trans[0, 1]) - lse(trans[1, 0] + a, trans[0, 0])
    expected = np.zeros((2, 2))
    for p in range(len(steps) - 1, 0, -1):
        at = starts[steps[p]] + p
        r = scores[at] + back[at]
        back[at - 1] = lse(trans[1, 1] + r, trans[1, 0]) - lse(trans[0, 1] + r, trans[0, 0])
        if pairs:
            a = forward[at - 1]
            t = np.stack([np.full(len(at), trans[0, 0]), trans[0, 1] + r, a + trans[1, 0], a + trans[1, 1] + r])
            t = np.exp(t - t.max(0))
            expected += (t / t.sum(0)).sum(1).reshape(2, 2)
    return forward + back, expected


def fit_chain(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 250, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions that maximise the labels' conditional likelihood (Adam, fixed number of rounds)."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    observed = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1)
    for k in range(1, rounds + 1):
        trans = w[-4:].reshape(2, 2)
        odds, expected = chain_marginals(x @ w[:-4], starts, lengths, trans, pairs=True)
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        grad = np.concatenate([x.T @ (y - p), (observed - expected).ravel()]) / len(y) - l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def _train_rows(batches):
    hashes = WordHashes()
    for batch in batches:
        x = [line_features(t, hashes) for t in text_bytes(batch.column(1))]
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([f.astype(np.float32).tobytes() for f, _ in x], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in x], pa.binary())], names=["doc_id", "y", "x", "n"])


def _means(weights: np.ndarray, trans: np.ndarray):
    def run(batches):
        hashes = WordHashes(200_000)
        for batch in batches:
            out = []
            for _, texts in text_pieces(batch.column(1), 500_000):
                parts = [line_features(t, hashes) for t in texts]
                lengths = np.array([len(n) for _, n in parts])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                odds, _ = chain_marginals(np.concatenate([f @ weights for f, _ in parts]), starts, lengths, trans)
                out.append(_mean(odds, np.concatenate([n for _, n in parts]), starts))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["doc_id", "mean"])

    return run


def _mean(odds: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of each document's marginals."""
    p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)


def quality_scores(docs: DataFrame, labels: DataFrame, *, held_out: Column | None = None, sample: int = 3_000, sample_lines: int = 200_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...).

    Learns from labels.quality of rows outside held_out (crc32 of doc_id modulo 5 is 0), from
    `sample` labelled documents with `sample_lines` lines in all at most (none of more than a
    hundredth of them): remainders 1 to 3 fit the chain, every line taking its document's label,
    and 4 the calibration. Null labels and labels of unknown documents count
    for nothing; with labels of one class only, all scores lie near it. A null or empty text is
    one blank line. A null doc_id is never held out. Repeated rows give repeated rows, an empty
    table none; other columns are ignored. Memory: a batch of texts with their line features.
    """
    docs = pick(docs, "doc_id", "text")
    fold = crc_fold("doc_id", 5)
    held_out = F.coalesce(fold == 0, F.lit(False)) if held_out is None else held_out
    rows = within_lines(labelled_sample(docs, labels, "quality", fold != 0, sample), sample_lines)
    rows = rows.select("doc_id", "text", "y").mapInArrow(_train_rows, "doc_id bigint, y int, x binary, n binary").withColumn("fold", fold).orderBy("doc_id").toArrow()
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(float) for b in rows.column("x").to_pylist()]
    n = [np.frombuffer(b, np.float32).astype(float) for b in rows.column("n").to_pylist()]
    y, part = rows.column("y").to_numpy().clip(0, 1).astype(float), rows.column("fold").to_numpy()
    own = [i for i in range(len(x)) if part[i] != 4]
    weights, trans = np.zeros(FEATURES), np.zeros((2, 2))
    if own:
        weights, trans = fit_chain(np.vstack([x[i] for i in own]), np.repeat(y[own], [len(x[i]) for i in own]), np.array([len(x[i]) for i in own]))
    means = lambda ids: np.array([_mean(chain_marginals(x[i] @ weights, np.zeros(1, int), np.array([len(x[i])]), trans)[0], n[i], np.zeros(1, int))[0] for i in ids])
    rest = [i for i in range(len(x)) if part[i] == 4] or own
    a, b = fit_logistic(means(rest).reshape(-1, 1), y[rest]) if rest else (0.0, 0.0)
    score = 1 / (1 + F.exp(-(F.col("mean") * float(a) + float(b))))
    scored = docs.mapInArrow(_means(weights, trans), "doc_id bigint, mean double")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def within_lines(rows: DataFrame, most: int) -> DataFrame:
    """The rows (doc_id, text, y) of a bounded sample, in the order of a hash of doc_id, as far as their lines sum to `most`."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = rows.withColumn("lines", F.coalesce(lines, F.lit(1)).cast("long")).where(F.col("lines") <= most // 100)
    sizes = rows.groupBy("doc_id").agg(F.sum("lines").alias("lines"))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    kept = sizes.withColumn("so_far", F.sum("lines").over(so_far)).where(F.col("so_far") <= most).select("doc_id")
    return rows.drop("lines").join(F.broadcast(kept), "doc_id", "left_semi")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
