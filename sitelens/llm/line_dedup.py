"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line counts with its white space folded; blank lines take no part. A line goes if an earlier
line (by doc_id, then line number) is equal to it, whatever its length, or, where both have at
least `edit_words` words, one word away from it: one word inserted, removed or replaced. Every line
that may have such a partner emits its variants as hashed keys: the line without word i, and the
line itself split before word i. Two different lines are within the bound just if they share a key,
so for each key only its earliest line matters; the partner found is verified on the words. Which
lines may have a partner is settled before that, exactly: lines within the bound share the first or
the last p words, p being four for every eight words of the line (of either neighbouring length
too), so a line alone with all of its such keys emits no variants. Lines, keys and partners that
very many rows share are joined by broadcast, the rest by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, dropped, hot_join, small_enough, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _folded(text: Column) -> Column:
    """The text with each run of white space but line ends as one space; its lines are still to be trimmed."""
    unusual = text.contains("  ")
    for c in "\t\r\x0b\x0c":
        unusual = unusual | text.contains(c)
    return F.when(unusual, F.regexp_replace(text, r"[\x09\x0B-\x0D ]+", " ")).otherwise(text)


def _words(folded: Column) -> Column:
    return F.when(folded == "", 0).otherwise(F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit(""))) + 1)


def _end(side: int, p: Column) -> Column:
    """Hash of the first (side 0) or last (side 1) p words."""
    return F.xxhash64(F.lit(side), p, F.call_function("substring_index", F.col("line"), F.lit(" "), -p if side else p))


def _rest(words: str, drop: str, at: str) -> Column:
    """The words without word number `at` where `drop`, else all."""
    w = F.col(words)
    return F.when(F.col(drop), F.concat(F.slice(w, F.lit(1), F.col(at)), F.slice(w, F.col(at) + 2, F.size(w)))).otherwise(w)


def dropped_lines(docs: DataFrame, edit_words: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, h, pos): the lines to drop; h = xxhash64(text)."""
    h = F.xxhash64("text")
    rows = docs.select("doc_id", h.alias("h"), F.posexplode(_lines(_folded(F.col("text")))).alias("pos", "line"))
    rows = rows.select("doc_id", "h", "pos", F.trim("line").alias("line")).where("line <> ''").withColumn("n", _words(F.col("line")))
    # lines too short for an edit have no ends
    rows = rows.withColumn("p", F.expr(f"if(n < {edit_words}, 0, int((n - 1) div 8) * 4)")).withColumn("q", F.expr(f"if(n < {edit_words}, 0, int((n + 1) div 8) * 4)"))
    ends = [F.when(cond, _end(side, F.col(c))).alias(f"{c}{side}") for c, cond in (("p", F.col("p") > 0), ("q", F.col("q") > F.col("p"))) for side in (0, 1)]
    rows = written(rows.select("doc_id", "h", "pos", F.xxhash64("line").alias("id"), "n", "p", "q", *ends), "lines")
    place = F.struct("doc_id", "h", "pos")
    known = ("n", "p", "q", "p0", "p1", "q0", "q1")
    lines = written(rows.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in known)), "distinct_lines")

    ends = F.array(*(F.struct(F.col(f"{c}{side}").alias("end"), F.col(c).alias("p"), F.lit(side).alias("side")) for c in "pq" for side in (0, 1)))
    ends = lines.select("id", F.explode(ends).alias("e")).where("e.end is not null").select("id", "e.*")
    shared = ends.groupBy("end").agg(F.count("*").alias("m")).where("m > 1").select("end")
    # an edit lies past the shared first words, or before the shared last words
    maybe = ends.join(shared, "end", "left_semi").groupBy("id").agg(F.min(F.when(F.col("side") == 0, F.col("p"))).alias("past"), F.min(F.when(F.col("side") == 1, F.col("p"))).alias("until"))
    where_table = where = written(lines.select("id", "first").join(maybe, "id").select("id", "first.*", "first", "past", "until"), "maybe")
    keys = where.select("doc_id", "h").distinct()
    texts = _joined(docs.select("doc_id", h.alias("h"), "text"), small_enough(keys, broadcast_rows), "left_semi")
    where = where.groupBy("doc_id", "h").agg(F.collect_list(F.struct("id", "pos", "first", "past", "until")).alias("wanted"))
    texts = _joined(texts, where).select(_lines(_folded(F.col("text"))).alias("all"), "wanted")
    texts = texts.select(F.explode(F.transform("wanted", lambda w: F.struct(*(w[c].alias(c) for c in ("id", "first", "past", "until")), F.split(F.trim(F.col("all")[w["pos"]]), " ").alias("words")))).alias("x")).select("x.*")
    texts = written(texts.dropDuplicates(["id"]), "candidates")

    words = texts.select("id", "first", "past", "until", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    words = words.withColumn("front", F.xxhash64("word", "i")).withColumn("back", F.xxhash64("word", F.col("n") - F.col("i"), F.lit(1)))
    own = Window.partitionBy("id")
    so_far = own.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("f", F.bit_xor("front").over(so_far)).withColumn("b", F.bit_xor("back").over(so_far)).withColumn("whole", F.bit_xor("front").over(own)).withColumn("back_whole", F.bit_xor("back").over(own))
    words = words.withColumn("before", F.col("f").bitwiseXOR(F.col("front"))).withColumn("after", F.col("back_whole").bitwiseXOR(F.col("b")))
    i, n = F.col("i"), F.col("n")
    possible = (F.col("past") <= i) | (i <= n - F.col("until"))
    variant = lambda before, after, left, at, drop: F.struct(F.xxhash64(before, after, left, at).alias("key"), at.alias("at"), F.lit(drop).alias("drop"))
    out = F.array(
        F.when(possible, variant(F.col("before"), F.col("after"), n - 1, i, True)),
        F.when(possible, variant(F.col("before"), F.col("after").bitwiseXOR(F.col("back")), n, i, False)),
        F.when((i == n - 1) & F.col("past").isNotNull(), variant(F.col("whole"), F.lit(0).cast("long"), n, n, False)),
    )
    variants = written(words.select("id", "first", F.explode(out).alias("v")).where("v is not null").select("id", "first.*", "v.*"), "variants")
    first = F.struct("doc_id", "h", "pos")
    heads = variants.groupBy("key").agg(F.min(F.struct("doc_id", "h", "pos", "id", "drop")).alias("head"), F.min("id").alias("i0"), F.max("id").alias("i1"), F.count("*").alias("m")).where("i0 <> i1").select("key", "head", "m")
    heads = written(heads, "heads")
    near = hot_join(variants, heads, "key", "m").where(F.expr("struct(head.doc_id, head.h, head.pos) < struct(doc_id, h, pos) and (drop or head.drop)"))
    near = near.groupBy("id").agg(F.min(F.struct(F.expr("struct(head.doc_id, head.h, head.pos)").alias("first"), F.col("head.id").alias("to"), "at", "drop", F.col("head.drop").alias("to_drop"))).alias("x")).select("id", "x.to", "x.at", "x.drop", "x.to_drop")
    near = written(near.join(texts.select("id", "words"), "id"), "near")
    partners = near.groupBy("to").agg(F.count("*").alias("m")).join(texts.select(F.col("id").alias("to"), F.col("words").alias("to_words")), "to")
    near = hot_join(near, written(partners, "partners"), "to", "m")
    near = near.where(_rest("words", "drop", "at") == _rest("to_words", "to_drop", "at")).select("id", F.lit(True).alias("near"))
    known = lines.select("id", F.col("first"), "times").join(near, "id", "left").where("times > 1 or near").select("id", F.col("first").alias("kept_at"), F.coalesce("near", F.lit(False)).alias("near"), "times")
    repeated = hot_join(rows.select("id", "doc_id", "h", "pos"), written(known, "repeated"), "id", "times")
    out = written(repeated.where(F.col("near") | ~first.eqNullSafe(F.col("kept_at"))).select("doc_id", "h", "pos").distinct(), "gone")
    dropped(rows, lines, where_table, texts, variants, heads, near, repeated)
    return out


def _joined(left: DataFrame, right: DataFrame, how: str = "inner", h: str = "h") -> DataFrame:
    """left with right's other columns, by doc_id (nulls equal) and the hash that left calls h."""
    right = right.withColumnsRenamed({"doc_id": "__doc_id", "h": "__right_h"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col(h) == F.col("__right_h")), how).drop("__doc_id", "__right_h")


def without_repeated_lines(docs: DataFrame, *, edit_words: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text, ...) with the text less its dropped lines, n_lines and n_dropped; n_chars follows where docs has it.

    Blank lines stay; lines under edit_words words go only for an equal one. Order is by doc_id (null first), then by
    xxhash64(text) among rows that repeat a doc_id, then by line number; rows that repeat both
    count as one document and come out alike. A null text stays null and has no lines to drop; a
    document whose lines all go has an empty text. An empty table gives no rows. Columns of docs
    named n_lines or n_dropped are replaced; others pass through. The lines to drop, and the
    documents to look lines up in, are broadcast only if they have at most broadcast_rows rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = dropped_lines(docs.select("doc_id", "text"), edit_words, broadcast_rows)
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    gone = gone.groupBy("doc_id", "h").agg(F.collect_list("pos").alias("__gone"))
    gone = F.broadcast(gone) if few else gone
    names = docs.columns
    out = _joined(docs.withColumn("__h", F.xxhash64("text")), gone, "left", "__h")
    lines, gone_lines = _lines(F.col("text")), F.col("__gone")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone_lines, i)), "\n")
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.when(gone_lines.isNull(), 0).otherwise(F.size(gone_lines)).cast("long"))
    out = out.withColumn("text", F.when(gone_lines.isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in names), "n_lines", "n_dropped")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM docs),
l AS (
  SELECT doc_id, pos, ws, array_to_string(ws, ' ') AS line
  FROM (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM raw)
  WHERE len(ws) > 0
), u AS (SELECT line, any_value(ws) AS ws, min({'d': doc_id, 'p': pos}) AS f FROM l GROUP BY line),
del AS (
  SELECT line, f, i, array_to_string(list_concat(ws[1:i], ws[i + 2:]), ' ') AS k
  FROM (SELECT line, f, ws, unnest(range(0, len(ws))) AS i FROM u WHERE len(ws) >= 8)
), near AS (
  SELECT a.line FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND b.f < a.f
  UNION SELECT a.line FROM del a JOIN u b ON a.k = b.line AND b.f < a.f AND len(b.ws) >= 8
  UNION SELECT a.line FROM u a JOIN del b ON a.line = b.k AND b.f < a.f AND len(a.ws) >= 8
), gone AS (
  SELECT l.doc_id, l.pos FROM l JOIN u ON u.line = l.line
  WHERE {'d': l.doc_id, 'p': l.pos} <> u.f OR l.line IN (SELECT line FROM near)
), kept AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.pos) AS t
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.pos = raw.pos
  WHERE gone.pos IS NULL GROUP BY raw.doc_id
), c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT docs.doc_id, len(ls)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_dropped,
  length(coalesce(kept.t, ''))::BIGINT AS n_chars, md5(coalesce(kept.t, '')) AS text_md5
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id LEFT JOIN c ON c.doc_id = docs.doc_id
"""
