"""Near-duplicate groups by a chosen-path set similarity join.

Documents are sets of word shingles. Documents with the same set are one class; classes carry a
one-permutation minwise signature (empty bins borrow from a fixed random order of bins). Each of
`trees` independent trees starts with all classes at its root. A node of more than `leaf` classes
branches: the node's path picks one signature position (a second one now and then, so that a pair
at the threshold is expected to stay together along one branch), and the classes part by the
minwise token there. The classes of a small node are compared exhaustively: first on sketches,
then on their full sets. A parity sketch (which of 512 buckets hold an odd number of shingles)
never shows more odd differences than the sets have, so what it refuses is no link; sets too large
for it are told apart by one-bit minwise sketches, whose bar lies six deviations below the threshold.

Before that, in two rounds, each class is compared with the likest of a few pivots of its nodes at
the roots of two trees, which links most groups at a cost that grows with the classes alone. The trees then skip
nodes whose classes are all in one component and compare across components only: a node is small
if at most `leaf` of its classes lie outside its largest component, and these are compared with all
of it. The number of trees follows from the recall wanted of a pair at the threshold that only a
node at `max_depth` tells apart. In a node that is still large there, each class is compared with
four pivots of the node; when these links have made components, all classes of such a node outside
its largest component are compared with all classes of other components, so that no link between
components is lost to the depth limit. The classes of a node are dealt out in blocks of `BLOCK`,
and what they are compared with goes to each of its blocks, so that no node fills a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, documents, dropped, hot_join, mix, shingle_hashes, small_enough, swept, text_pieces, written
from .graph import components

BINS = 128
#: Buckets of the parity sketch, a multiple of 64.
PARITY = 512
#: Rounds of pivots before the search and the trees of each, and the pivots of a node.
ROUNDS, ROUND_TREES, PIVOTS = 2, 2, 4
#: Bytes of text that a task reads at once, and words whose hashes it remembers.
PIECE, WORDS = 500_000, 150_000
#: Classes of a node in one block.
BLOCK = 1000
#: Narrow tables of at most so many rows (nodes, labels, pairs, ids) are broadcast: what they are joined with is not dealt out then.
FEW = 200_000
_ODD = [f"o{i}" for i in range(PARITY // 64)]
_SKETCH = ["n", "s0", "s1", *_ODD]
_SIG_SCHEMA = f"doc_id bigint, h bigint, n bigint, class bigint, s0 bigint, s1 bigint, {', '.join(f'{c} bigint' for c in _ODD)}, sig binary, paths array<bigint>"


def _text_pieces(batches) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """(batch, first row, texts of column 1) of pieces of bounded size."""
    for batch in batches:
        for at, texts in text_pieces(batch.column(1), PIECE):
            yield batch, at, texts


def _orders() -> np.ndarray:
    rng = np.random.default_rng(20240601)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def _sets(texts: list[bytes], k: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased, words between ASCII white space."""
    for t in texts:
        yield np.unique(shingle_hashes(hashes.of(t.lower().split()), k))


def _signature(u: np.ndarray, orders: np.ndarray) -> np.ndarray:
    bins = (u >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]], full[bins[first]] = u[first], True
    if len(first) < BINS:
        empty = np.flatnonzero(~full)
        rows = orders[empty]
        sig[empty] = sig[rows[np.arange(len(empty)), full[rows].argmax(1)]]
    return (mix(sig ^ (np.arange(BINS, dtype=np.uint64) * GOLDEN)) >> np.uint64(32)).astype(np.uint32)


def _parity(u: np.ndarray) -> np.ndarray:
    """Which of PARITY buckets hold an odd number of the set's hashes, as 64-bit words."""
    return np.packbits((np.bincount((u % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def _signatures(k: int, trees: int):
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * GOLDEN)
    bins = (roots % np.uint64(BINS)).astype(np.int64)

    def run(batches):
        hashes, orders = WordHashes(WORDS), _orders()
        for batch, first, texts in _text_pieces(batches):
            rows = {name: [] for name in ("n", "class", "s0", "s1", *_ODD, "sig", "paths")}
            for u in _sets(texts, k, hashes):
                row = {"n": len(u)}
                if len(u):
                    sig = _signature(u, orders)
                    bits = np.packbits((mix(sig.astype(np.uint64) + GOLDEN) & np.uint64(1)).astype(np.uint8)).view(np.int64)
                    row |= {"class": _class(u), "s0": int(bits[0]), "s1": int(bits[1]), "sig": sig.tobytes(), **dict(zip(_ODD, _parity(u).tolist()))}
                    row["paths"] = mix(roots ^ mix(sig[bins].astype(np.uint64) + GOLDEN)).view(np.int64)
                for name, values in rows.items():
                    values.append(row.get(name))
            kinds = {"sig": pa.binary(), "paths": pa.list_(pa.int64())}
            yield pa.record_batch([batch.column(0).slice(first, len(texts)).cast(pa.int64()), batch.column(2).slice(first, len(texts)), *(pa.array(v, kinds.get(name, pa.int64())) for name, v in rows.items())], names=["doc_id", "h", *rows])

    return run


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair of that similarity is still together in some node at the depth of a tree."""
    second, p = 1 / similarity - 1, 1.0
    for _ in range(depth - 1):
        apart = 1 - similarity * p
        p = 1 - (1 - second) * apart - second * apart**2
    return similarity * p


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """Trees after which a pair of that similarity has been together at the depth with chance `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _branch(similarity: float):
    """(class, node, sig, label) -> (class, node, label): the children in which the class lies."""
    second = np.uint64(int((1 / similarity - 1) * 2**32))

    def run(batches):
        for batch in batches:
            node = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(node), BINS)
            h = mix(node + GOLDEN)
            one = (h % np.uint64(BINS)).astype(np.int64)
            two = ((h >> np.uint64(8)) % np.uint64(BINS)).astype(np.int64)
            kept = np.flatnonzero(((h >> np.uint64(32)) < second) & (one != two))
            row = np.arange(len(node))
            ids = np.concatenate([row, row[kept]])
            pos = np.concatenate([one, two[kept]])
            child = mix(node[ids] ^ mix(sig[ids, pos].astype(np.uint64) + pos.astype(np.uint64) * GOLDEN))
            yield pa.record_batch([batch.column(0).take(pa.array(ids)), pa.array(child.view(np.int64)), batch.column(3).take(pa.array(ids))], names=["class", "node", "label"])

    return run


def _class(u: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(u.tobytes()) - 2**63


def _shingle_rows(k: int):
    def run(batches):
        hashes = WordHashes(WORDS)
        for _, _, texts in _text_pieces(batches):
            sets = [u for u in _sets(texts, k, hashes) if len(u)]
            yield pa.record_batch([pa.array(map(_class, sets), pa.int64()), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))], names=["class", "items"])

    return run


def _bar(similarity: float) -> int:
    """Fewest equal bits of BINS that a pair at the threshold shows, less six deviations."""
    p = (1 + similarity) / 2
    return math.floor(BINS * p - 6 * math.sqrt(BINS * p * (1 - p)))


def _place():
    """Where a row stands: by doc_id, null last, then by the hash of its text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")


def _components_of(docs: DataFrame, k: int, percent: int, trees: int | None, recall: float, leaf: int, max_depth: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc_id, h, n, class; h = xxhash64(text), class null for empty sets), classes (class, first_id, first, m, label; m: its rows) and all else that was written."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie in 50..100")
    similarity, bar = percent / 100, _bar(percent / 100)
    trees = trees or trees_for(recall, min(similarity, 0.99), max_depth)
    spark = docs.sparkSession
    swept(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("h"))
    signed = written(docs.mapInArrow(_signatures(k, trees), _SIG_SCHEMA), "signed")
    some = signed.where("class is not null")
    classes = written(some.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min(_place()).alias("first"), F.count("*").alias("m"), *(F.first(c).alias(c) for c in (*_SKETCH, "sig", "paths"))), "classes")

    def compared(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of classes of the same node and block, under different labels, that may reach the threshold."""
        x = x.select("node", "block", *(F.col(c).alias(f"a_{c}") for c in ("class", "label", *_SKETCH)))
        y = y.select("node", "block", *(F.col(c).alias(f"b_{c}") for c in ("class", "label", *_SKETCH)))
        small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
        same = F.lit(BINS) - F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) - F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
        odd = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _ODD[1:]), F.bit_count(F.col("a_o0").bitwiseXOR(F.col("b_o0"))))
        close = (F.col("a_label") != F.col("b_label")) & (100 * small >= percent * large) & ((100 + percent) * odd <= (100 - percent) * (small + large)) & ((small < 64) | (same >= bar))
        pairs = x.join(y, ["node", "block"]).where(close)
        return pairs.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"), same.alias("same"))

    empty = spark.createDataFrame([], "a bigint, b bigint")
    few = lambda rows, n: F.broadcast(rows) if n <= FEW else rows
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = lambda rows: rows.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    everywhere = lambda rows: rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def against_pivots(rows: DataFrame, salt: int, nodes: int) -> DataFrame:
        """Each class of rows (node, m, class, label and sketch; m: classes of the node; `nodes` nodes at most) with PIVOTS classes of its node at most."""
        least = [F.min(F.struct(F.xxhash64("class", F.lit(salt + i)), "class", "label", *_SKETCH)).alias(f"p{i}") for i in range(PIVOTS)]
        bare = (F.struct(*(F.col(f"p{i}.{c}") for c in ("class", "label", *_SKETCH))) for i in range(PIVOTS))
        pivots = rows.groupBy("node").agg(F.first("m").alias("m"), *least).select("node", "m", F.explode(F.array_distinct(F.array(*bare))).alias("p"))
        pivots = pivots.select("node", "m", "p.*")
        if nodes <= FEW // 20:
            return compared(rows.withColumn("block", F.lit(0)), F.broadcast(pivots.withColumn("block", F.lit(0))))
        return compared(dealt(rows), everywhere(pivots))

    def likest(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, same), each class with its likest partner."""
        ends = F.array(*(F.struct(F.col(c).alias("x"), F.struct("same", F.col(d).alias("y")).alias("m")) for c, d in (("a", "b"), ("b", "a"))))
        one = pairs.select(F.inline(ends)).groupBy("x").agg(F.max("m").alias("m"))
        return written(one.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct(), "first")

    def at_roots(labelled: DataFrame, first: int, last: int, salt: int) -> DataFrame:
        """Each class with the likest of the pivots of its nodes at the first level of trees first..last."""
        rows = labelled.select("class", "label", *_SKETCH, F.explode(F.slice("paths", first + 1, last - first)).alias("node"))
        several = written(rows.groupBy("node").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("m")).where("l0 <> l1").select("node", "m", F.col("m").alias("n_rows")), "several")
        rows = written(hot_join(rows, several, "node", "n_rows", few=FEW), "roots")
        best = likest(against_pivots(rows, salt, several.count()))
        dropped(several, rows)
        return best

    def descend(labelled: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Pairs to confirm from all trees, and the rows of nodes that are large to the end. labelled: (class, label, sig, paths, sketch)."""
        found, dense = [], []
        slim = labelled.select("class", "label", *_SKETCH)
        frontier = labelled.select("class", "label", F.explode("paths").alias("node"))
        for depth in range(1, max_depth + 1):
            # a node whose classes are all linked already has nothing to find
            sizes = frontier.groupBy("node", "label").agg(F.count("*").alias("m"))
            counts = sizes.groupBy("node").agg((F.sum("m") - F.max("m")).alias("others"), F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("m")).where("others > 0")
            counts = written(counts.withColumn("n_rows", F.col("m")), "counts")
            held = written(hot_join(frontier.select("class", "node"), counts, "node", "n_rows", few=FEW), "held")
            dropped(counts, *([frontier] if depth > 1 else []))
            n_small, n_large = held.agg(F.count_if(F.col("others") <= leaf), F.count_if(F.col("others") > leaf)).first()
            if n_small:
                small = few(held.where(F.col("others") <= leaf).select("node", "m", "class", "main"), n_small).join(slim, "class")
                found.append(written(compared(everywhere(small.where("label <> main")), dealt(small)), "pairs"))
            if not n_large:
                dropped(held)
                break
            large = held.where(F.col("others") > leaf).select("class", "node", "m")
            if depth == max_depth:
                dense = [written(large.join(slim, "class"), "dense")]
                found.append(written(against_pivots(dense[0], ROUNDS * PIVOTS, n_large // leaf), "pairs"))
                dropped(held)
                break
            frontier = large.join(labelled.select("class", "label", "sig"), "class").select("class", "node", "sig", "label").mapInArrow(_branch(similarity), "class bigint, node bigint, label bigint")
            frontier = written(frontier, "frontier")
            dropped(held)
        pairs = empty.withColumn("same", F.lit(0))
        for p in found:
            pairs = pairs.unionByName(p)
        pairs = written(pairs.groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")
        dropped(*found)
        return pairs, dense

    def confirmed(chosen: DataFrame) -> DataFrame:
        """Those pairs (each there once) whose full sets are close enough."""
        chosen = written(chosen.select("a", "b"), "chosen")
        n = chosen.count()
        if not n:
            dropped(chosen)
            return empty
        ends = chosen.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("m"))
        ids = written(classes.select("class", F.col("first.doc_id").alias("wanted_id"), F.col("first.h").alias("wanted_h")).join(few(ends, n), "class"), "ids")
        wanted = ids.select("wanted_id", "wanted_h")
        own = docs.join(small_enough(wanted), docs["doc_id"].eqNullSafe(F.col("wanted_id")) & (docs["h"] == F.col("wanted_h")), "left_semi")
        items = own.select("doc_id", "text").mapInArrow(_shingle_rows(k), "class bigint, items array<bigint>").dropDuplicates(["class"])
        items = written(items.join(few(ids.select("class", "m"), n), "class"), "items")
        # a class that very many pairs share: its set goes to each block of them
        found = ids.agg(F.max("m").alias("most"), F.sum("m").alias("all")).first()
        line = max(BLOCK, found["all"] // 100_000)

        def with_items(pairs: DataFrame, c: str, other: str, size: int) -> DataFrame:
            """pairs (size: its rows, if it is narrow) with the sets of their ends c."""
            sets = items.select(F.col("class").alias(c), F.col("items").alias(f"{c}_items"), "m")
            if found["most"] <= line:
                return few(pairs, size).join(sets.drop("m"), c)
            hubs = sets.where(F.col("m") > line)
            hot = F.broadcast(hubs.select(c, "m"))
            marked = pairs.join(hot, c).withColumn("block", F.pmod(F.xxhash64(other), blocks).cast("int")).drop("m")
            rest = few(pairs.join(hot, c, "left_anti"), size).join(sets.where(F.col("m") <= line).drop("m"), c)
            return rest.unionByName(marked.join(everywhere(hubs).drop("m"), [c, "block"]).drop("block"))

        both = with_items(with_items(chosen, "a", "b", n), "b", "a", FEW + 1)
        shared = F.size(F.array_intersect("a_items", "b_items"))
        union = F.size("a_items") + F.size("b_items") - shared
        links = written(both.where(100 * shared >= percent * union).select("a", "b"), "confirmed")
        dropped(chosen, ids, items)
        return links

    def across(p: DataFrame) -> DataFrame:
        """Without pairs whose ends are linked already."""
        lab = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        return p.join(lab("a"), "a", "left").join(lab("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")

    labelled = lambda rows: rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    links, tried, labels = empty, empty, spark.createDataFrame([], "node bigint, label bigint")

    def linked(more: DataFrame) -> None:
        """Take these pairs as links too."""
        nonlocal links, labels
        if not more.isEmpty():
            links = links.unionByName(more)
            dropped(labels)
            labels = small_enough(components(links), 2 * FEW)

    for i in range(ROUNDS):
        pairs = at_roots(labelled(classes), min(i * ROUND_TREES, trees), min((i + 1) * ROUND_TREES, trees), i * PIVOTS)
        linked(confirmed(pairs.join(tried, ["a", "b"], "left_anti")))
        tried = small_enough(tried.unionByName(pairs), FEW)
    swept(spark)
    tree_rows = written(labelled(classes).drop("m"), "labelled")
    found, dense = descend(tree_rows)
    pairs = written(found.join(tried, ["a", "b"], "left_anti"), "pairs")
    # each class against its likest candidate, then what these leave apart
    first = small_enough(likest(pairs), FEW)
    linked(confirmed(first))
    linked(confirmed(across(pairs.join(first, ["a", "b"], "left_anti"))))
    for rows in dense:
        parts = labelled(rows.drop("label"))
        sizes = parts.groupBy("node", "label").agg(F.count("*").alias("of_label"))
        largest = sizes.groupBy("node").agg(F.max_by("label", F.struct("of_label", "label")).alias("main"), F.count("*").alias("parts"), F.sum("of_label").alias("n_rows")).where("parts > 1")
        parts = written(hot_join(parts, written(largest.drop("parts"), "largest"), "node", "n_rows", few=FEW), "parts")
        rest = compared(everywhere(parts.where("label <> main")), dealt(parts)).select("a", "b").distinct()
        linked(confirmed(rest.join(pairs, ["a", "b"], "left_anti").join(tried, ["a", "b"], "left_anti")))
        dropped(parts)
    named = written(labelled(classes.select("class", "first_id", "first", "m")), "named")
    dropped(classes, tree_rows, found, pairs, first, links, tried, labels, *dense)
    return signed, named, [signed, named]


def near_duplicate_groups(docs: DataFrame, *, k: int = 3, percent: int = 85, trees: int | None = None, recall: float = 0.9999, leaf: int = 150, max_depth: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    A link joins two documents whose sets of k-word shingles have 100 * intersection >=
    percent * union. component_id is the smallest doc_id reachable; kept: it is the document's
    own. A null or blank text has an empty set and no links; with fewer than k words the whole
    sequence is one shingle. Rows with equal sets, repeated rows and rows of equal doc_id among
    them, are linked; a null doc_id has the component_id of those it is linked with, or null. An
    empty table gives no rows; other columns are ignored. Memory: one batch of texts a task.
    `trees`: by default as many as `recall` wants at `max_depth` levels.
    """
    signed, named, _ = _components_of(docs, k, percent, trees, recall, leaf, max_depth)
    lowest = written(named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_rows")), "lowest")
    named = written(hot_join(named.select("class", "label", F.col("m").alias("of_class")), lowest, "label", "n_rows", few=FEW).select("class", "component_id", "of_class"), "named")
    out = hot_join(signed.select("doc_id", F.col("n").alias("n_shingles"), "class"), named, "class", "of_class", how="left", few=FEW)
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each_group(docs: DataFrame, *, k: int = 5, percent: int = 80, trees: int | None = None, recall: float = 0.9999, leaf: int = 150, max_depth: int = 8) -> DataFrame:
    """docs without the rows whose group of near copies has an earlier one: by doc_id (null last), then by xxhash64(text).

    Of rows that repeat doc_id and text one stays, the first by a hash of all its columns. Rows
    without words (null and blank texts) are near copies of nothing and all stay; different texts
    under one doc_id are told apart. An empty table gives none; all columns pass through. What
    goes is broadcast if it has at most a million (doc_id, hash) pairs, else joined by a shuffle.
    """
    signed, named, tables = _components_of(docs, k, percent, trees, recall, leaf, max_depth)
    best = written(named.groupBy("label").agg(F.min("first").alias("best"), F.count("*").alias("n_rows")), "best")
    named = written(hot_join(named.select("class", "label", F.col("m").alias("of_class")), best, "label", "n_rows", few=FEW).select("class", "best", "of_class"), "named")
    rows = written(hot_join(signed.select("doc_id", "h", "class"), named, "class", "of_class", few=FEW).select("doc_id", "h", (_place() != F.col("best")).alias("goes")).groupBy("doc_id", "h", "goes").agg(F.count("*").alias("n")), "places")
    gone = written(rows.where("goes").select(F.col("doc_id").alias("__id"), F.col("h").alias("__of_text")), "gone")
    twice = written(rows.where("not goes and n > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__of_text")), "twice")
    dropped(best, named, rows, *tables)
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    same = lambda: F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__of_text"))
    kept = keyed.join(small_enough(gone), same(), "left_anti")
    if twice.isEmpty():
        return kept.select(*names)
    repeated = kept.join(small_enough(twice), same(), "left_semi")
    one = repeated.groupBy("doc_id", "__h").agg(F.min_by(F.struct(*names), F.xxhash64(F.to_json(F.struct(*names)))).alias("__row")).select("__row.*")
    return kept.join(small_enough(twice), same(), "left_anti").select(*names).unionByName(one)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  WITH RECURSIVE reach(src, dst) AS (
    SELECT a, b FROM e UNION SELECT reach.src, e.b FROM reach JOIN e ON e.a = reach.dst
  ) SELECT src, min(dst) AS lo FROM reach GROUP BY src
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
  least(d.doc_id, coalesce(r.lo, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(r.lo, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.src = d.doc_id
"""
