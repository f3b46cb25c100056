"""Nulls, repeats, clashes, long texts, ties and empty tables for every operator; brute force for models and joins."""

from __future__ import annotations

import math
import os
import random
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import common, fingerprints, html_text, learn, line_dedup, mixing, near_dedup, packing, perplexity, quality, token_counts, toxicity
from sitelens.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


def labels(spark):
    return spark.createDataFrame([(None, 1, 1), *((i, None if i == 3 else i % 2, i % 2) for i in range(1, 12))], "doc_id long, quality int, toxic int")


#: name -> (operator on (spark, docs), its rows for each row of docs, or None)
OPERATORS = {
    "near_dedup": (lambda spark, d: near_dedup.near_duplicate_groups(d), 1),
    "keep_one": (lambda spark, d: near_dedup.keep_one_of_each_group(d), None),
    "quality": (lambda spark, d: quality.quality_scores(d, labels(spark)), 1),
    "packing": (lambda spark, d: packing.packed(d), None),
    "token_counts": (lambda spark, d: token_counts.token_counts(d), 1),
    "line_dedup": (lambda spark, d: line_dedup.without_repeated_lines(d), 1),
    "mixing": (lambda spark, d: mixing.mixed(d), None),
    "fingerprints": (lambda spark, d: fingerprints.fingerprints_with_edits(d), 1),
    "quality_rules": (lambda spark, d: perplexity.quality_rules(d), 1),
    "quality_rules_joined": (lambda spark, d: perplexity.quality_rules(d, broadcast_ngrams=0), 1),
    "toxicity": (lambda spark, d: toxicity.toxicity_scores(d, labels(spark)), 1),
    "without_toxic": (lambda spark, d: toxicity.without_toxic(d, labels(spark)), None),
}
CLASHES = ["id", "h", "n", "key", "class", "label", "node", "bucket", "rank", "start", "length", "offset", "fold", "y", "x", "score", "kept", "copy_no", "mix_key", "n_lines", "size", "rate", "share", "row", "pos", "line", "__source2"]


def hard_rows(spark):
    rows = [(None, None, None, None, None), (None, "x y", None, "s", 3), (1, None, "en", None, None), (2, "", "", "", 0), (3, " \t\n ", "en", "s", 4), (4, "same words here", "en", "s", 15), (5, "same words here", "en", "s", 15), (5, "same words here", "en", "s", 15), (5, "other text under the same id", "en", "t", 28), (6, LONG, "en", "s", len(LONG)), (7, "\x00 naïve 日本語 \U0001f600", "fr", "s", 12)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    f, each = OPERATORS[name]
    rows = hard_rows(spark)
    out = f(spark, rows)
    got = out.collect()
    if each:
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows.collect())
    shared = [c for c in out.columns if c not in CLASHES or c in ("start", "length", "offset", "score", "kept", "copy_no", "mix_key", "n_lines")]
    again = f(spark, rows.select("*", *(F.lit("clash").alias(c) for c in CLASHES))).select(*shared).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in (r.__class__(**{c: r[c] for c in shared}) for r in got)), name
    empty = f(spark, rows.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_keep_one_tells_texts_under_one_id_apart(spark):
    got = near_dedup.keep_one_of_each_group(hard_rows(spark)).collect()
    assert Counter((r.doc_id, (r.text or "")[:12]) for r in got) == Counter([(None, ""), (None, "x y"), (1, ""), (2, ""), (3, " \t\n "), (4, "same words h"), (5, "other text u"), (6, LONG[:12]), (7, "\x00 naïve 日本語 ")])


def test_line_dedup_of_hot_and_short_lines(spark):
    hot = "the very same line of nine words stands here"
    texts = [f"{hot}\nok\nown line number {i} of this document here\nrow {i} of the table has some other value" for i in range(1200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.without_repeated_lines(rows).collect()}
    assert got[0] == texts[0].split("\n") and sum(hot in x for x in got.values()) == 1 and sum("ok" in x for x in got.values()) == 1
    # a family of lines one word apart: only the earliest of eight words or more stays
    assert sum(any(x.startswith("own line") for x in lines) for lines in got.values()) == 1
    assert sum(any(x.startswith("row ") for x in lines) for lines in got.values()) == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how):
    rows = spark.range(3000).select((F.when(F.col("id") < 1500, 7).otherwise(F.col("id"))).alias("k"), "id")
    table = common.written(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k % 2 = 1"), "table")
    plain = rows.join(table.drop("n"), "k", how)
    assert sorted(map(repr, common.hot_join(rows, table, "k", "n", how=how).collect())) == sorted(map(repr, plain.collect()))


def test_components_of_an_ordered_path(spark):
    steps = []
    got = components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long"), rounds=steps).collect()
    assert len(got) == 1001 and {r.label for r in got} == {0} and sum(steps) <= 12


def test_links_labelled_in_the_driver_as_by_rounds(spark):
    rng = random.Random(3)
    links = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(450)] + [(i, i + 1) for i in range(1000, 1300)] + [(7, 7), (None, 3), (9999, 9999)]
    links = spark.createDataFrame(links, "a long, b long")
    assert sorted(components(links).collect()) == sorted(components(links, local=0).collect()) == sorted(components(links, rounds=[]).collect())


@pytest.mark.parametrize("few", [200_000, 0])
def test_near_dedup_with_small_tables_broadcast_and_dealt_out(spark, few):
    """Few labels, pairs and nodes go by broadcast, so that few stages have a task for each partition of a shuffle; the rows are the same where nothing is few."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    for _ in range(40):
        words = list(base)
        for i in rng.sample(range(200), rng.choice([2, 9])):
            words[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts += texts[:20]
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    lowest = list(range(len(texts)))
    for _ in range(6):
        for i, x in enumerate(sets):
            lowest[i] = min(lowest[j] for j, y in enumerate(sets) if 100 * len(x & y) >= 85 * len(x | y))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    near_dedup.FEW, kept = few, getattr(near_dedup, "FEW", None)
    sc.setJobGroup(group := f"near_dedup with {few}", group)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = near_dedup.near_duplicate_groups(rows, trees=2, leaf=10, max_depth=2).collect()
    finally:
        near_dedup.FEW = kept
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(lowest))
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    dealt = sum(info.numTasks >= 23 and info.numCompletedTasks > 0 for s in stages if (info := tracker.getStageInfo(s)))
    assert not few or 0 < dealt <= 32, dealt


def test_trees_follow_from_the_recall():
    assert near_dedup.survival(0.85, 1) == 0.85
    for depth in (1, 5, 8):
        p = near_dedup.survival(0.85, depth)
        n = near_dedup.trees_for(0.999, 0.85, depth)
        assert 1 - (1 - p) ** n >= 0.999 > 1 - (1 - p) ** (n - 1)


def test_near_copies_among_texts_just_under_the_threshold(spark):
    """A family at 0.8, in which some pairs stand at 0.87: nodes stay large, so branching and blocks have to find them."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(400), n):
            words[i] = f"x{rng.randrange(10**9)}"
        return words

    family = [edited(base, 8) for _ in range(300)]
    texts = [" ".join(t) for t in [*family, *(edited(family[i], 9) for i in range(20))]]
    near_dedup.BLOCK, kept = 50, near_dedup.BLOCK
    try:
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_groups(rows, leaf=10, max_depth=4).collect()}
    finally:
        near_dedup.BLOCK = kept
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    links = [(a, b) for b in range(320) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {(i, 300 + i) for i in range(20)} <= set(links)
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)


def test_packing_uses_the_plain_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "plain words, isn't it?  two\n\nlines 123", "naïve ſ É"]
    out = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        parts = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [r.ids_crc32 for r in parts] == [crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts] and sum(r.length for r in parts) == len(ids)


def test_packing_plan_fills_windows():
    for seed in range(40):
        rng = random.Random(seed)
        window = rng.choice([16, 64, 1024])
        counts = {rng.randrange(1, window): rng.randrange(1, 20) for _ in range(rng.randrange(60))}
        plan, filled = packing.Plan(counts, window), defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                at = 0
                for start, size, sequence, offset in sorted(plan.place(length, rank)):
                    assert start == at
                    at += size
                    filled[sequence].append((offset, size))
                assert at == length
        assert set(filled) == set(range(plan.sequences))
        short = 0
        for parts in filled.values():
            end = 0
            for offset, size in sorted(parts):
                assert offset == end
                end += size
            assert end == window or end & (end - 1) == 0 and end < window
            short += end < window
        assert short <= window.bit_length()


def kneser_ney(texts, ys, shared=4.0, shared_pairs=10.0):
    """P(word | before) of both classes, by dictionaries."""
    pairs = defaultdict(lambda: [0, 0])
    for t, y in zip(texts, ys, strict=True):
        w = [None, *(x.decode() for x in toxicity.tokens(t.encode()))]
        for p in set(zip(w, w[1:])):
            pairs[p][y] += 1

    def taken(counts, n):
        ones = [sum(1 for c in counts if c == i) for i in (1, 2, 3, 4)]
        d = toxicity.discounts(ones)
        return {1: d[0], 2: d[1] / 2}.get(n, d[2] / max(n, 3))

    cont = defaultdict(lambda: [0, 0, 0])
    for (_, w), n in pairs.items():
        cont[w][0] += n[0] > 0
        cont[w][1] += n[1] > 0
        cont[w][2] += 1
    both, alls = [c[0] + c[1] for c in cont.values()], [c[2] for c in cont.values()]
    lost = lambda w, c: cont[w][c] * (taken(both, cont[w][0] + cont[w][1]) if c < 2 else taken(alls, cont[w][2]))
    total, freed = ([sum(x[c] for x in cont.values()) for c in range(3)], [sum(lost(w, c) for w in cont) for c in range(3)])
    known, rare = len(cont), freed[2] / total[2] / (len(cont) + 1)
    size = [total[c] / (total[0] + total[1]) for c in (0, 1)]
    lower = lambda w: (cont[w][2] - lost(w, 2)) / total[2] + rare
    word = lambda w, c: (cont[w][c] - lost(w, c) + shared * size[c] + freed[c] * lower(w)) / (total[c] + shared * size[c] * known) if w in cont else freed[c] * rare / (total[c] + shared * size[c] * known)
    sums = [n[0] + n[1] for n in pairs.values()]
    share = [sum(n[c] for n in pairs.values()) / sum(sums) for c in (0, 1)]
    after = defaultdict(list)
    for v, w in pairs:
        after[v].append(w)

    def pair(v, w, c):
        if v not in after:
            return word(w, c)
        count = [sum(pairs[v, x][k] for x in after[v]) for k in (0, 1)]
        part = [(count[k] + shared * share[k]) / (sum(count) + shared) for k in (0, 1)]
        own = lambda x: shared_pairs * part[c] * word(x, c) / (part[0] * word(x, 0) + part[1] * word(x, 1))
        off = lambda x: pairs[v, x][c] * taken(sums, sum(pairs[v, x]))
        z = count[c] + part[c] * shared + sum(own(x) for x in after[v])
        back = sum(off(x) for x in after[v]) + part[c] * shared
        top = pairs[v, w][c] - off(w) + own(w) if (v, w) in pairs else 0.0
        return (top + back * word(w, c)) / z

    return pair, cont


def test_toxicity_models_match_dictionaries(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(12)) + (" vile words" if i % 3 == 0 else "") for i in range(40)]
    ys = [int(i % 3 == 0) for i in range(40)]
    counted = spark.createDataFrame(list(zip(texts, ys, strict=True)), "text string, y int").mapInArrow(toxicity._count, "key bigint, before bigint, word bigint, n0 bigint, n1 bigint")
    rows = toxicity.class_models(counted).toArrow()
    evidence, hashes = toxicity.Evidence(*(rows.column(c).to_numpy() for c in ("kind", "key", "ratio"))), common.WordHashes()
    pair, cont = kneser_ney(texts, ys)
    for v in (None, "w0", "w3", "vile"):  # a distribution over the known words and one for the rest
        for c in (0, 1):
            mass = sum(pair(v, w, c) for w in cont)
            assert 0.5 < mass <= 1 + 1e-9
    for t in [*texts[:8], "vile w1 unseen vile words w2", "unseen"]:
        w = [x.decode() for x in toxicity.tokens(t.encode())]
        exact = [math.log(pair(a, b, 1) / pair(a, b, 0)) for a, b in zip([None, *w], w)]
        h = hashes.of([x.encode() for x in w])
        assert np.allclose(evidence.ratios(h, np.concatenate([[toxicity.START], h[:-1]])), exact, atol=1e-4)
        assert np.allclose(evidence.features([h])[0], [np.mean(exact), max(exact)], atol=1e-4)


def test_toxicity_is_the_same_in_any_order(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + (" foul" if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    one = sorted(map(repr, toxicity.toxicity_scores(rows, marks).collect()))
    two = sorted(map(repr, toxicity.toxicity_scores(rows.repartition(5, "text").orderBy(F.desc("doc_id")), marks.repartition(3)).collect()))
    assert one == two
    for y in (0, 1):  # labels of one class
        got = toxicity.toxicity_scores(rows, marks.where(F.col("toxic") == y)).collect()
        assert len(got) == 200 and {r.predicted for r in got} == {y}


def test_toxicity_learns_from_every_labelled_row(spark):
    # the only documents that show the class of "vile" are the last by hash of doc_id, past any 12,000
    ids = spark.range(16_200).select(F.col("id").alias("doc_id")).where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").orderBy(F.xxhash64("doc_id"))
    last = [r.doc_id for r in ids.collect()[12_000:]]
    assert len(last) > 100
    foul = F.col("doc_id").isin(last)
    rows = spark.range(16_200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id"), F.lit(" b"), F.col("id") % 7, F.when(foul, F.lit(" vile vermin")).otherwise(F.lit(" mild kitten"))).alias("text"))
    marks = rows.select("doc_id", foul.cast("int").alias("toxic"))
    more = spark.createDataFrame([(99_999, "b1 vile vermin"), (99_998, "b1 mild kitten")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(rows.unionByName(more), marks).where("doc_id > 50000").collect()}
    assert got == {99_999: 1, 99_998: 0}


def test_toxicity_by_joins_equals_that_by_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(30)) + (" foul" if i % 4 == 0 else "") for i in range(200)]
    rows = spark.createDataFrame([*enumerate(texts), (7, texts[8]), (None, "w1 foul"), (300, None), (301, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    one = sorted(map(repr, toxicity.toxicity_scores(rows, marks).collect()))
    monkeypatch.setattr(toxicity, "PART_ROWS", 200)
    monkeypatch.setattr(toxicity, "FEW_WORDS", 5)
    assert sorted(map(repr, toxicity.toxicity_scores(rows, marks).collect())) == one
    assert sorted(map(repr, toxicity.toxicity_scores(rows, marks, broadcast_rows=10).collect())) == one


def test_toxicity_beyond_broadcast_deals_out_little(spark, monkeypatch):
    # a row a pair, dealt out three times, took several times the texts' size
    rng = random.Random(7)
    word = lambda: f"word{int(rng.paretovariate(0.6)) % 3000}"
    texts = [" ".join(word() for _ in range(300)) + (" foul" if i % 4 == 0 else "") for i in range(120)]
    rows = spark.createDataFrame([*enumerate(texts), (200, texts[3]), (201, None), (202, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    one = sorted(map(repr, toxicity.toxicity_scores(rows, marks).collect()))
    sizes, real = spark.sparkContext.accumulator(0), toxicity._asked

    def asked(*args):
        run = real(*args)

        def measured(batches):
            for batch in run(batches):
                sizes.add(sum(len(x or b"") for c in (4, 5, 6) for x in batch.column(c).to_pylist()) + 8 * sum(len(x) for x in batch.column(2).to_pylist()))
                yield batch

        return measured

    monkeypatch.setattr(toxicity, "_asked", asked)
    monkeypatch.setattr(toxicity, "BUCKET_ROWS", 5_000)
    assert sorted(map(repr, toxicity.toxicity_scores(rows, marks, broadcast_rows=10).collect())) == one
    # the texts are asked for twice at most: those of the calibration, and all
    assert 0 < sizes.value < 1.5 * sum(map(len, texts))
    monkeypatch.setattr(toxicity, "VOCABULARY_ROWS", 10)
    assert sorted(map(repr, toxicity.toxicity_scores(rows, marks, broadcast_rows=10).collect())) == one


def test_toxicity_result_holds_no_model(spark, monkeypatch):
    # else a caller that keeps one result while it makes the next has two models in the driver
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + (" foul" if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    sent, real = [], toxicity.sent
    monkeypatch.setattr(toxicity, "PART_ROWS", 200)
    monkeypatch.setattr(toxicity, "sent", lambda *a: sent.extend(found := real(*a)) or found)
    scores = toxicity.toxicity_scores(rows, marks)
    assert len(sent) > toxicity.SWEEP_PARTS
    assert not any(b._jbroadcast.isValid() or os.path.exists(b._path) for b in sent)
    got = sorted(map(repr, scores.collect()))
    assert len(got) == 200
    # by joins: only the table of features stays
    own = lambda: set(os.listdir(f"{common.shared_dir(spark)}/sitelens"))
    before = own()
    joined = toxicity.toxicity_scores(rows, marks, broadcast_rows=10)
    assert {x.partition("-")[0] for x in own() - before} == {"scored"}
    assert sorted(map(repr, joined.collect())) == got


def test_logistic_fit_by_sums_equals_that_on_the_driver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(float)
    table = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x0 double, x1 double, y double")
    one, two = (learn.fit_logistic_table(table, ["x0", "x1"], "y", collected=n) for n in (1000, 10))
    assert np.allclose(one, learn.fit_logistic(x, y)) and np.allclose(one, two, atol=1e-6)
    assert all(learn.fit_logistic_table(table.where(f"y = {v}"), ["x0", "x1"], "y", collected=1)[-1] == (6.0 if v else -6.0) for v in (0, 1))


def brute_main(lines, lengths):
    """Windows of three lines; from the first that is not empty to the last."""
    full = [i for i in range(len(lengths)) if sum(lengths[j] for j in range(len(lengths)) if abs(i - j) <= 1)]
    inside = [i for i in full if lengths[i]]
    return (inside[0], inside[-1] + 1) if inside else (0, 0)


def test_surge_and_dive_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, rng.randrange(1, 200)]) for _ in range(rng.randrange(12))]
        assert html_text.surge_and_dive(lengths) == brute_main(None, lengths)
        assert html_text.window_sums(lengths) == [sum(lengths[max(i - 1, 0) : i + 2]) for i in range(len(lengths))]


def test_every_page_goes_through_surge_and_dive(spark, monkeypatch):
    seen, real = [], html_text.surge_and_dive
    monkeypatch.setattr(html_text, "surge_and_dive", lambda x: seen.append(len(x)) or real(x))
    for page in ("<article><p>one</p></article>", "<main><p>two</p></main>", "<div><p>three</p></div>", ""):
        html_text.main_blocks(page)
    assert seen == [1, 1, 1, 0]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, '<a ">"' * 170_000, "<button>" * 130_000, "<div>" * 100_000 + "</section>" * 90_000, "<!--" * 250_000, "<p class=" + " " * 900_000 + "x>"])
def test_broken_markup_takes_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 3


def test_html_hard_pages(spark):
    long = "<article>" + "<p>word </p>" * 30_000 + "</article>"
    rows = [(None, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, "v", long), (3, "w", "<table><tr><td>a<td>b</table>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extracted(df.select("*", F.lit(1).alias("n_chars"), F.lit(2).alias("text"))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 30_000 * 6 - 2), (3, 3)]
    assert html_text.extracted(df.limit(0)).count() == 0


def test_quality_rules_counts_match_plain_python(spark):
    rng = random.Random(4)
    texts = ["", None, "# a | b $ c", *("\n".join(" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 8))) for _ in range(40)), "a b c d e f g h " * 4]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in perplexity.quality_rules(rows).collect():
        t = texts[r.doc_id] or ""
        words = t.split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_perplexity_matches_dictionaries(spark):
    """Interpolated modified Kneser-Ney of code points, order 4."""
    texts = ["abracadabra abra", "cadabra bra bra", "abba cabbage bread", "dab a bad cab"]
    counts = [Counter() for _ in range(5)]
    for t in texts:
        counts[4].update(t[i : i + 4] for i in range(len(t) - 3))
    for m in (3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])

    def cut(m):
        n = [sum(1 for c in counts[m].values() if c == i) for i in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        return [min(max(i - (i + 1) * y * n[i] / max(n[i - 1], 1), 0.1), i - 0.1) if n[0] and n[i - 1] else 0.6 * i for i in (1, 2, 3)]

    def p(g):
        m, d = len(g), cut(len(g))
        take = lambda c: min(d[min(c, 3) - 1], c)
        same = [c for x, c in counts[m].items() if x[:-1] == g[:-1]]
        freed = sum(map(take, same)) / sum(same)
        lower = p(g[1:]) if m > 1 else 1 / (len(counts[1]) + 1)
        return (counts[m][g] - take(counts[m][g])) / sum(same) + freed * lower

    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    for i, t in enumerate(texts):
        total = -sum(math.log(p(t[j : j + 4])) for j in range(len(t) - 3))
        assert got[i].log_ppl == pytest.approx(total / len(t.split()), abs=1e-4) and got[i].log_ppl_char == pytest.approx(total / (len(t) - 3), abs=1e-4)


def test_fingerprints_merge():
    text = "the quick brown fox jumps over the lazy dog " * 3 + "".join(chr(97 + i * i % 26) for i in range(900))
    parts = [text[:500], text[500 - 11 :]]  # overlapping, so that no shingle is lost
    whole, merged = fingerprints.fingerprint(text), fingerprints.fingerprint(parts[0]).merged(fingerprints.fingerprint(parts[1]))
    assert str(whole) == str(merged)
    small = fingerprints.fingerprint("a small text of its own")
    assert small.rest is not None and fingerprints.containment(small, fingerprints.fingerprint("a small text of its own kind")) == 1.0


def test_token_counts_of_long_pretokens():
    scores = token_counts.load_pieces()
    rng = random.Random(1)
    word = "".join(rng.choice(["the", "ing", "x", "日", "é", "q"]) for _ in range(700))
    trie = token_counts.PieceTrie(scores)
    assert trie.outside(token_counts.MARK + word) == trie.insert(token_counts.MARK + word) and len(trie.score) > 1
    small = token_counts.PieceTrie(scores)
    assert small.count((word * 2).encode()) == trie.insert(token_counts.MARK + word * 2) and len(small.score) == 1


def test_pipeline_of_all_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(120)) + f"\nline {i} with words of its own {i * 7} and {i * 13} more here {i}" for i in range(90)]
    near = [t.replace(t.split()[5], "changed", 1) for t in clean[:5]]
    foul = [" ".join(rng.choice(vocabulary) for _ in range(60)) + " vile foul rotten" for _ in range(60)]
    texts = [*clean, *near, clean[6], *foul, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(96 <= i < 156)) for i in range(156) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    docs = common.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = Counter(r.doc_id for r in docs.collect())
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
    foul_ids = set(range(96, 156))
    assert len(foul_ids & set(kept["toxicity"])) <= 3 and set(range(96)) <= set(kept["toxicity"])
    assert kept["line_dedup"] == kept["toxicity"]
    assert set(kept["near_dedup"]) <= set(kept["line_dedup"]) and set(range(90)) - set(kept["near_dedup"]) == set()
    assert set(kept["packing"]) == set(kept["mixing"]) <= set(kept["near_dedup"])
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in result) == kept["packing"]
    pieces = defaultdict(int)
    for r in result:
        pieces[r.doc_id] += r.length
    again = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in again} == dict(pieces)
