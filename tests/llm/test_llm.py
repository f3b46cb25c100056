from __future__ import annotations

import hashlib
import os
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import common, fingerprints, html_text, line_dedup, mixing, near_dedup, packing, perplexity, quality, token_counts, toxicity
from sitelens.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sets(text, k):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 3), (20, 5), (21, 20), (5, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 21: 2, 8: 8, 9: 8, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "ONE two", "one"]
    for _ in range(8):
        base = words(rng, rng.randrange(30, 200))
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicate_groups(rows, leaf=6, max_depth=3).collect()}
    s = {i: sets((t or "").lower(), 3) for i, t in enumerate(texts, 1)}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    expected = groups(s, links)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.n_shingles == len(s[i]) and r.kept == (expected[i] == i) for i, r in got.items())
    kept = near_dedup.keep_one_of_each_group(rows.unionByName(rows), k=3, percent=85)
    blank = [i for i in s if not s[i]]  # near copies of nothing: repeats of them stay too
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*set(expected.values()), *blank]) and kept.columns == rows.columns
    assert near_dedup.near_duplicate_groups(rows.limit(0)).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = [None, "", "<|endoftext|> x", "naïve 日本語\n\n  z", *(" ".join(words(rng, rng.randrange(1, 900))) for _ in range(60))]
    rows = docs(spark, texts).withColumn("length", F.lit("clash"))
    out = packing.packed(rows).collect()
    tokenizer = packing.load_tokenizer(None)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts, 1)}
    seen, filled = Counter(), {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, r.start + j) for j in range(r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(seen) == sum(map(len, ids.values())) and max(seen.values()) == 1
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    assert packing.packed(rows.limit(0)).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        sums = {0}
        for k, v in counts.items():
            sums = {s + k * j for s in sums for j in range(v + 1)}
        fill = packing.best_fill(counts, 60)
        assert sum(k * v for k, v in fill.items()) == max(s for s in sums if s <= 60) and all(v <= counts[k] for k, v in fill.items())


def test_token_counts(spark):
    scores = token_counts.load_pieces()

    def best(word):
        word, table = "▁" + word, [(0.0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(table[j][0] + scores[word[j:i]], table[j][1] + 1) for j in range(i) if word[j:i] in scores]
            n = len(word[i - 1].encode())
            ways.append((table[i - 1][0] + token_counts.BYTE_SCORE * n, table[i - 1][1] + n))
            table.append(max(ways, key=lambda x: x[0]))
        return table[-1][1]

    texts = [None, "", " \t", "the theory of theories", "naïve 日本語 xqzj", "the the"]
    got = {r.doc_id: (r.n_chars, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs(spark, texts)).collect()}
    assert got == {i: (len(t or ""), len((t or "").split()), sum(map(best, (t or "").split()))) for i, t in enumerate(texts, 1)}
    small = token_counts.PieceTrie(scores, most=5)
    assert [small.count(w.encode()) for w in ("theory", "theories", "theory")] == [best("theory"), best("theories"), best("theory")]


def test_line_dedup(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota"
    texts = [None, "", f"{line}\nshort line\n\nshort line\nshort  words", line, line.replace("gamma", "GAMMA") + "\nunique one of my own with many more words here", line + " kappa", line.replace("beta ", ""), "beta " + line, line.replace("eta ", "x ").replace("iota", "y"), f" {line.replace(' ', '  ')} \t"]
    rows = docs(spark, texts).withColumn("h", F.lit(1)).withColumn("gone", F.lit(2))
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(rows).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].text == f"{line}\nshort line\n\nshort  words" and got[3].n_lines == 5 and got[3].n_dropped == 1
    assert [got[i].text for i in (4, 6, 7, 8, 10)] == [""] * 5 and got[4].n_chars == 0
    assert got[5].text == "unique one of my own with many more words here" and got[5].n_dropped == 1
    assert got[9].text == texts[8] and got[9].h == 1 and got[9].gone == 2
    assert line_dedup.without_repeated_lines(rows.limit(0)).count() == 0


def test_mixing(spark):
    rows = docs(spark, [None, "", *("word " * (i % 7) for i in range(400))]).withColumn("copy_no", F.lit("old"))
    rows = rows.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    out = mixing.mixed(rows, weights={"s0": 1.0, "s1": 3.0, None: 0.0}).collect()
    size = Counter()
    for r in out:
        size[r.source] += len(r.text or "") + 1
    assert size[None] == 0 and 2 < size["s1"] / size["s0"] < 4.5 if size["s0"] else size["s1"]
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mixed(rows, weights={"s0": 1.0, "s1": 3.0, None: 0.0}).collect()))
    assert mixing.mixed(rows.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.3, 4.0, 700.0])
def test_poisson_steps(spark, rate):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate))).first()[0]
    assert abs(steps[-1] - 1) < 1e-9 and abs(sum(1 - s for s in steps) - rate) < 1e-6 * max(rate, 1)


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [None, "", "tiny", *(" ".join(words(rng, rng.randrange(5, 300))) for _ in range(30)), "tiny"]
    rows = docs(spark, texts).collect()
    got = {r.doc_id: r for r in fingerprints.fingerprints_with_edits(docs(spark, texts)).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, n = r.text or "", len(r.text or "")
        edited = t[: n - n // 3] + (after.text or "")[: n // 3]
        own, changed = fingerprints.fingerprint(t), fingerprints.fingerprint(edited)
        assert got[r.doc_id].fingerprint == str(own) and got[r.doc_id].edited_fingerprint == str(changed)
        assert got[r.doc_id].n_chars == n and got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[r.doc_id].near_edited == fingerprints.containment(own, changed)
        assert got[r.doc_id].near_next == fingerprints.containment(own, fingerprints.fingerprint(after.text or ""))
        for estimate, other in ((got[r.doc_id].near_edited, edited), (got[r.doc_id].near_next, after.text or "")):
            a, b = ({x[i : i + 12] for i in range(max(len(x) - 11, 1))} if x else set() for x in (t, other))
            exact = len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)
            assert abs(estimate - exact) <= (0 if max(len(a), len(b)) <= 64 else 0.3 if min(len(a), len(b)) > 64 else 1)
    assert got[3].fingerprint == got[len(texts)].fingerprint != ""
    assert fingerprints.fingerprints_with_edits(docs(spark, ["alone"])).count() == 1
    assert fingerprints.fingerprints_with_edits(docs(spark, texts).limit(0)).count() == 0


def test_perplexity_paths_agree(spark):
    rng = random.Random(4)
    rows = docs(spark, [None, "", "abc", *(" ".join(words(rng, rng.randrange(20, 120))) for _ in range(25)), "a b c d e f g h " * 9]).withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    one = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    two = {r.doc_id: r for r in perplexity.quality_rules(rows, broadcast_ngrams=0).collect()}
    assert one.keys() == two.keys() and all((one[i].log_ppl is None) == (two[i].log_ppl is None) and (one[i].log_ppl is None or abs(one[i].log_ppl - two[i].log_ppl) < 1e-4) for i in one)
    assert one[1].base_failed and not one[1].kept and one[29].n_repeat_words == 72 and one[29].base_failed
    model = perplexity.ngram_model(rows.where("doc_id > 3").select("text", F.lit("x").alias("lang"))).collect()
    assert all(r.logp <= 1e-6 for r in model)
    sums = Counter()
    for r in model:
        sums[(r.key & (2**64 - 1)) >> 16] += np.exp(r.logp)
    assert max(sums.values()) <= 1 + 1e-5
    assert perplexity.quality_rules(rows.limit(0)).count() == 0


def labelled(spark, bad):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 60) + ([bad] * 4 if i % 4 == 0 else [])) for i in range(300)]
    return docs(spark, [*texts, None, ""]), spark.createDataFrame([(i + 1, None if i == 7 else int(i % 4 == 0)) for i in range(300)], "doc_id long, y int")


def test_toxicity(spark):
    rows, labels = labelled(spark, "blasted")
    got = toxicity.toxicity_scores(rows, labels.withColumnRenamed("y", "toxic")).collect()
    assert len(got) == 302 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all((r.predicted == 1) == ((r.doc_id - 1) % 4 == 0) for r in got if r.held_out and r.doc_id <= 300)
    kept = toxicity.without_toxic(rows, labels.withColumnRenamed("y", "toxic"))
    assert kept.columns == rows.columns and 220 <= kept.count() <= 232
    assert toxicity.toxicity_scores(rows, labels.limit(0).withColumnRenamed("y", "toxic")).count() == 302
    assert toxicity.toxicity_scores(rows.limit(0), labels.withColumnRenamed("y", "toxic")).count() == 0


def test_toxicity_evidence_loses_confirmed_copies_of_one_label_only(spark):
    rng = random.Random(8)
    base = words(rng, 60)
    shared = [f"common pair x{i}" for i in range(20)]
    near = [" ".join([*base, f"end{i}"]) for i in range(5)]
    rows = [*((t, 0) for t in shared), (shared[0].upper() + "!", 0), (shared[0], 1), *((t, 1) for t in near), (near[0], 0), ("", 0), (None, 1)]
    got = toxicity.without_copies(spark.createDataFrame(rows, "text string, y int")).collect()
    seen = Counter((" ".join(w.decode() for w in toxicity.tokens(r.text.encode())), r.y) for r in got if r.text)
    assert max(seen.values()) == 1 and {(t, 0) for t in [*shared, near[0]]} | {(shared[0], 1)} <= set(seen)
    assert len(seen) == 23 and sum((t, 1) in seen for t in near) == 1


def test_toxicity_knows_an_expression_of_few_documents(spark):
    rows, labels = labelled(spark, "blasted")
    toxic = [i for i in range(1, 301, 4) if i != 8 and crc32(str(i).encode()) % 4 < 2][:3]
    rows = rows.withColumn("text", F.when(F.col("doc_id").isin(toxic), F.concat("text", F.lit(" vile vermin"))).otherwise(F.col("text")))
    plain = " ".join(words(random.Random(1), 20))
    rows = rows.unionByName(docs(spark, [f"{plain} vile vermin", f"{plain} mild kitten"], 1001))
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(rows, labels.withColumnRenamed("y", "toxic")).where("doc_id > 1000").collect()}
    assert got[1001] > got[1002]


def test_quality(spark):
    rows, labels = labelled(spark, "LOUD!! NOISE!! ### $$$")
    got = quality.quality_scores(rows, labels.selectExpr("doc_id", "1 - y AS quality")).collect()
    assert len(got) == 302 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [(r.predicted == 0) == ((r.doc_id - 1) % 4 == 0) for r in got if r.held_out and r.doc_id <= 300]
    assert sum(right) >= 0.95 * len(right)
    assert quality.quality_scores(rows, labels.limit(0).withColumnRenamed("y", "quality")).count() == 302


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lengths, trans = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    starts, scores = np.array([0, 1, 5]), rng.normal(size=8)
    odds, _ = quality.chain_marginals(scores, starts, lengths, trans)
    for s, n in zip(starts, lengths, strict=True):
        total, ones = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [code >> j & 1 for j in range(n)]
            p = np.exp(sum(scores[s + j] * y[j] for j in range(n)) + sum(trans[y[j - 1], y[j]] for j in range(1, n)))
            total, ones = total + p, ones + p * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-odds[s : s + n])), ones / total)


def test_html_text(spark):
    page = (
        "<html><head><title>T</title></head><body><div id=header><a href=/>Home</a> My site</div><ul class='main-menu'><li><a href=x>One</a></ul><div class=cookieNotice>We use cookies.</div>"
        "<div class=post><h1>Title</h1><p>First &amp; <a href=z>link</a> text<br>goes on for a while here.<p>Two.<aside>Side</aside><p>Third &#8220;x&#8221; &nbsp; para, long enough.</div>"
        "<section id=comments><p>nice post</section><footer>c 2020</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<article><p>unclosed <b>bold<p>x &am"), (5, "x", "<nav>only menu</nav>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(rows.withColumn("text", F.lit("clash"))).collect()}
    assert got[1] == "Title\n\nFirst & link text goes on for a while here.\n\nTwo.\n\nThird “x” para, long enough."
    assert got[2] == got[3] == got[5] == "" and got[4] == "unclosed bold\n\nx &am"


def test_html_text_between_inline_adverts():
    long, short = "long words here " * 70, "a closing paragraph of the article, short but part of it."
    page = f"<body><div><h1>Title</h1><p>{long}</p><div class=ad>buy</div><p>{short}</p><aside>x</aside><p>Tiny end.</p></div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></body>"
    assert html_text.main_blocks(page) == ["Title", long.strip(), short, "Tiny end."]


def test_html_text_keeps_sibling_articles_and_unmarked_text():
    one, two = "first part " * 30, "second part " * 20
    page = f"<body><p>menu</p><div><article><header class='entry-header'><h1>Title</h1></header><p>{one}</p></article><article><p>{two}</p></article></div></body>"
    assert html_text.main_blocks(page) == ["Title", one.strip(), two.strip()]
    page = f"<body><div><p>{one}</p><p>{two}</p></div><article><p>A teaser.</p></article></body>"
    assert html_text.main_blocks(page)[:2] == [one.strip(), two.strip()]


def test_html_text_dives_at_lists_of_links():
    one, two = "first part " * 30, "second part " * 20
    links = "".join(f"<li><a href={i}>Menu entry {i}</a></li>" for i in range(4))
    # a menu without a name between the site's title and the text, and one in the middle; a single link stays
    page = f"<body><div>My site</div><ul>{links}</ul><div><p>{one}</p><p><a href=x>See this</a></p><p>{two}</p></div><ul>{links}</ul><p>The end.</p></body>"
    assert html_text.main_blocks(page) == ["My site", one.strip(), "See this", two.strip(), "The end."]
    # teasers around an article go, its own list of links stays
    teaser = "<article><h3><a href=x>Another story of the day</a></h3></article>"
    page = f"<body>{teaser * 2}<article><h1>Title</h1><p>{one}</p><ul>{links}</ul><p>{two}</p></article>{teaser * 3}</body>"
    assert html_text.main_blocks(page) == ["Title", one.strip(), *(f"Menu entry {i}" for i in range(4)), two.strip()]


def test_pipeline(spark):
    import corpus_pipeline

    stages = corpus_pipeline.STAGES
    rng = random.Random(9)
    texts = ["\n".join(" ".join(words(rng, 12, 5000)) for _ in range(5)) for _ in range(40)]
    rows = docs(spark, texts + texts[:3])
    for name, stage in stages[1:4]:
        rows = stage(spark, rows, "")
        assert rows.columns == [c.split()[0] for c in DOCS.split(", ")], name
    assert [n for n, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_parity_sketches_never_refuse_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 148, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 1 + n // 20).astype(np.uint64)]))
            odd = int(np.bitwise_count((near_dedup._parity(a) ^ near_dedup._parity(b)).view(np.uint64)).sum())
            differing = len(np.setxor1d(a, b))
            assert odd <= differing and (odd - differing) % 2 == 0
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                assert 185 * odd <= 15 * (len(a) + len(b))
    assert not near_dedup._parity(np.zeros(0, np.uint64)).any()


def test_dropped_tables_are_gone_and_others_stay(spark, tmp_path):
    one, two = common.written(spark.range(3), "one"), common.written(spark.range(0), "two")
    own = tmp_path / "own"
    spark.range(2).write.parquet(str(own))
    path = one.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    common.dropped(one, two, spark.read.parquet(str(own)))
    assert not os.path.exists(path) and own.exists()
