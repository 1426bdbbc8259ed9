"""Small fixtures against brute force, libraries and DuckDB; odd inputs for each operator."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quadrille.llm import ann, components, decontaminate, jaccard_join, licenses, lm_score, pieces, quality, spm_codec, substring_dedup, text, token_counts, toxicity  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a  b\t\nc ", "x" * 5000, "word " * 3000, "é漢\x00 <s>▁▁ </s>", "same", "same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, long ones, repeated rows, a null id and columns whose names clash."""
    rows = [(i if i else None, t, "n", 7) for i, t in enumerate(ODD)] + [(8, "same", "n", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_words int")


def test_words_and_hashes():
    texts = ["a  bb\ta", None, "", "\x0bé É a"]
    (s,) = text.slices(pa.array(texts))
    w = text.words(s)
    got = [bytes(s.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == ["a", "bb", "a", "é", "É", "a"] and list(w.bounds) == [0, 3, 3, 3, 6]
    assert w.hashes[0] == w.hashes[2] == w.hashes[5] and len(set(w.hashes.tolist())) == 4
    assert text.words(s, lower=True).hashes[4] == w.hashes[4]  # only A-Z is lowered
    cut = pa.array(["zz", *texts]).slice(1)
    (t,) = text.slices(cut)
    assert (text.words(t).hashes == w.hashes).all()


def test_encoding_is_the_librarys(spark, odd):
    model = pieces.load(MODEL)
    for r in spm_codec.encode_decode(odd, MODEL).collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == model.decode(model.encode(r["text"] or ""))
    assert spm_codec.encode_decode(odd.limit(0), MODEL).count() == 0
    r = random.Random(1)
    table, small = pieces.ChunkTable(MODEL), pieces.ChunkTable(MODEL, most=3)
    for _ in range(500):
        t = "".join(r.choice(" ▁\n\tabcdeingth éñ漢\x00😀<s></s>") for _ in range(r.randint(0, 40)))
        for which in (table, small):
            ids, decoded = which.encode([t])
            assert ids[0].tolist() == model.encode(t) and decoded[0] == model.decode(model.encode(t))


def test_prefix_counts(spark, odd):
    table, model, r = pieces.PrefixTable(MODEL), pieces.load(MODEL), random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(" ▁\n\tabcdeingth éñ漢\x00😀<s></s>") for _ in range(r.randint(1, 40)))
        counts = [len(model.encode(t[:i])) for i in range(len(t) + 1)]
        (got,) = table.at_chars([t])
        assert got.tolist() == counts
        budget = r.randint(0, 25)
        assert token_counts._within(got, budget) == max(i for i, c in enumerate(counts) if c <= budget)
    for row in token_counts.token_counts(odd, MODEL, budget=10).collect():
        t = row["text"] or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(t.encode()), len(model.encode(t)))
        assert len(model.encode(t[: row["cut_chars"]])) <= 10
    assert token_counts.token_counts(odd.limit(0), MODEL).count() == 0
    kept = token_counts.token_counts(odd.where("length(text) < 100 or text is null"), MODEL, keep_prefixes=True)
    for row in kept.select("text", "prefix_tokens", token_counts.tokens_of(3).alias("of_3"), token_counts.chars_within(2).alias("in_2")).collect():
        t = row["text"] or ""
        counts = [len(model.encode(t[:i])) for i in range(len(t) + 1)]
        assert row["prefix_tokens"] == counts and row["of_3"] == (counts[3] if len(t) >= 3 else None)
        assert row["in_2"] == max(i for i, c in enumerate(counts) if c <= 2)


def test_toxicity(spark, odd):
    a = toxicity.Lexicon().automaton()
    hit = lambda t: [w for *_, w in toxicity.hits(t, a)]
    assert hit("You IDIOT") and hit("1d10t!") and hit("іdiоt$$$") and hit("id​iot")
    assert not hit("idiotic") and not hit("a trash can") and not hit("xidiot") and not hit("")
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        ws = ["".join(r.choice("aeioulnr") for _ in range(r.randint(4, 9))) for _ in range(60)]
        if i % 4 == 0:
            for k in range(3):
                ws[r.randrange(60)] = "grumz" + r.choice(["en", "ak", "o"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, "toxic", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    got = {x["doc_id"]: x["toxic_score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert all(0 <= x["toxic_score"] < 0.7 for x in toxicity.score(odd, model).collect())
    assert toxicity.fit(docs, marks.limit(0), "toxic", F.lit(True)).entries == toxicity.Lexicon().entries


def test_toxic_hits_and_scores_match_brute_force(spark):
    model = toxicity.Lexicon({("bad", False): 1.0, ("badly", False): 2.0, ("grum", True): 1.5, ("lybad", True): 0.5}, (-3.0, 2.0, 1.0), ("bad hair day", "not badly"))

    def plain(t):
        low, folded = toxicity.fold(t)
        safe = [(i, i + len(p)) for p in model.exceptions for i in range(len(low)) if folded.startswith(p, i) and not low[:i][-1:].isalpha() and not low[i + len(p) :][:1].isalpha()]
        out = []
        for i in range(len(low)):
            fits = [(w, i + len(x)) for (x, stem), w in model.entries.items() if folded.startswith(x, i) and not low[:i][-1:].isalpha() and (stem or not low[i + len(x) :][:1].isalpha())]
            if fits and not any(a <= i and max(fits)[1] <= b for a, b in safe):
                out.append((i, max(fits)[1], max(fits)[0]))
        return out

    r, a = random.Random(8), model.automaton()
    texts = ["".join(r.choice(["bad", "b4d", "badly", "grum", "ly", " ", " ", "not ", "hair day", ".", "é", "\u200b", "x"]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    assert all(toxicity.hits(t, a) == plain(t) for t in texts) and any(plain(t) for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in toxicity.score(docs, model).collect():
        total = sum(w for *_, w in plain(row["text"]))
        x = -3.0 + 2.0 * math.log1p(total) + math.log1p(100 * total / (row["text"].count(" ") + 101))
        assert row["toxic_score"] == pytest.approx(1 / (1 + math.exp(-x)))


def test_log_densities_match_brute_force():
    g = np.random.default_rng(3)
    x = np.vstack([g.normal(0, 1, (300, 4)) @ g.normal(0, 1, (4, 4)), g.normal(1, 2, (200, 4))])
    y = np.repeat([0, 1], [300, 200])
    model = quality.train(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = 0.6 * own[0] + 0.4 * own[1]
    pooled = (1 - quality.SHRINK_TO_SPHERE) * pooled + quality.SHRINK_TO_SPHERE * np.trace(pooled) / 4 * np.eye(4)
    logs = []
    for k in (0, 1):
        c = (1 - quality.SHRINK_TO_POOLED) * own[k] + quality.SHRINK_TO_POOLED * pooled + 1e-6 * np.eye(4)
        off = z - z[y == k].mean(0)
        logs.append(np.array([-0.5 * o @ np.linalg.solve(c, o) for o in off]) - 0.5 * np.linalg.slogdet(c)[1] + math.log(np.mean(y == k)))
    assert np.allclose(model.difference(x), logs[1] - logs[0])


def test_quality(spark, odd):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        ws = ["".join(r.choice("aeioulnr") for _ in range(r.randint(2, 9))) for _ in range(80)]
        if i % 4 == 0:
            ws = [w.upper() + "!!" for w in ws[:20]] * 4
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 != 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.fit(docs, marks, "quality", allowed)
    got = {x["doc_id"]: x["quality_score"] for x in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 != 0) for i in got if zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(0 <= x["quality_score"] <= 1 for x in quality.score(odd, model).collect())
    assert all(x["quality_score"] == 1 for x in quality.score(odd, quality.fit(docs, marks.where("quality = 1"), "quality", allowed)).collect())
    assert quality.score(odd.limit(0), model).count() == 0


def test_repeats_match_brute_force(spark, odd):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    base = [r.choice(words) for _ in range(300)]
    rows = [(0, None), (7, "a b"), (7, "a b"), (None, "z " * 80), (100, "")]
    for i in range(40):
        a = r.randint(0, 200)
        d = base[a : a + r.randint(20, 100)]
        if r.random() < 0.5:
            d = d + [r.choice(words) for _ in range(50)] + d[: r.randint(0, 60)]
        if r.random() < 0.5:
            d[r.randrange(len(d))] = f"edit{i}"
        rows.append((i % 30, " ".join(d)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((d, *x) for (d, _), x in zip(rows, substring_dedup.brute_force([t for _, t in rows]), strict=True)), key=str)
    limit = substring_dedup.SHARD_WORDS
    try:
        for shard in (limit, 60):  # by automata, and by counted windows
            substring_dedup.SHARD_WORDS = shard
            out = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
            assert sorted(map(tuple, out.collect()), key=str) == want
    finally:
        substring_dedup.SHARD_WORDS = limit
    out = substring_dedup.remove_repeats(odd)
    assert out.count() == len(ODD) + 1 and sorted(out.columns) == sorted(["doc_id", "ids", "text", "n_words", "n_removed"])
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_automaton():
    a = substring_dedup.SuffixAutomaton()
    for s in ([1, 2, 3, 4, 5], [9, 2, 3, 4, 8]):
        a.add(s)
    a.finish()
    assert a.matching([1, 2, 3, 4, 5], 3).tolist() == [False, False, False, True, False]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 9, 200)
    for width in (1, 2, 5, 28):
        assert substring_dedup.sliding_min(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(200 - width + 1)]


def test_join_matches_brute_force(spark, odd):
    r = random.Random(3)
    base = [f"w{r.randint(0, 500)}" for _ in range(60)]
    rows = [(100, None), (101, ""), (102, "A b"), (103, "a B"), (104, "a b c")]
    for i in range(50):
        d = list(base)
        for _ in range(r.randint(0, 4)):
            d[r.randrange(60)] = f"e{r.randint(0, 9)}"
        rows.append((i + 1, " ".join(d)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(jaccard_join.brute_force([i for i, _ in rows], [t for _, t in rows]))
    for block in (jaccard_join.BLOCK, 12):  # large blocks whole, and in pieces
        assert sorted(map(tuple, jaccard_join.join_components(docs, block=block).collect())) == want
    kept_ids = {x["doc_id"] for x in jaccard_join.keep_one(docs).collect()}
    assert kept_ids == {c for *_, c in want}
    assert jaccard_join.join_components(odd).count() == len(ODD) + 1
    assert jaccard_join.join_components(odd.limit(0)).count() == 0


def test_components_are_done_or_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    for few in (0, 1000):
        assert {x["component"] for x in components.components(chain, few=few).collect()} == {0}
        assert components.components(chain.limit(0), few=few).count() == 0
    with pytest.raises(RuntimeError):
        components.components(chain, most_steps=1)


def test_one_row_of_each_component_stays(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "stuv")
    rows = [(3, one), (5, one), (5, two), (7, two), (9, three), (9, three), (None, four), (None, four), (None, four + " end"), (None, one), (11, ""), (11, None), (None, ""), (None, ""), (9, " ")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    got = {(x["id"], x["n_shingles"], x["component"]) for x in jaccard_join.join_components(docs).collect()}
    known = [r for r in rows if r[0] is not None]
    assert {x for x in got if x[0] is not None} == set(jaccard_join.brute_force([i for i, _ in known], [t for _, t in known]))
    assert (7, 37, 3) in got and all(c is None for i, _, c in got if i is None)
    kept = [(x["doc_id"], x["text"]) for x in jaccard_join.keep_one(docs).collect()]
    fours = [x for x in kept if x[0] is None and x[1]]
    assert len(fours) == 1 and fours[0][1].startswith(four)
    assert sorted([x for x in kept if x[0] in (3, 5, 7, 9) and (x[1] or "").strip()]) == [(3, one), (5, two), (9, three)]
    assert len([x for x in kept if not (x[1] or "").strip()]) == 5 and len(kept) == 9  # rows without words all stay


def test_unlike_texts_of_one_id_stay(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "st")
    docs = spark.createDataFrame([(3, one, 1, "x"), (7, one, 2, "y"), (7, two, 3, "z")], "doc_id long, text string, id int, row string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(3, one, 1, "x"), (7, two, 3, "z")]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_hot_groups_of_near_copies(spark):
    """Many copies, each like the base alone, and unlike texts with a common passage."""
    r = random.Random(9)
    base, other, passage = ([f"{c}{i}" for i in range(100)] for c in "bop")
    rows = [(0, " ".join(base)), (1, " ".join(other))]
    for i in range(2, 160):
        d = list(base if i % 2 else other)
        for at in r.sample(range(4, 96), 3 if i % 20 else 9):
            d[at] = f"e{r.randint(0, 400)}"
        rows.append((i, " ".join(d)))
    for i in range(160, 220):
        rows.append((i, " ".join([*passage[: r.randint(20, 30)], *(f"u{r.randint(0, 30)}" for _ in range(3))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for percent in (85, 60):
        want = sorted(jaccard_join.brute_force([i for i, _ in rows], [t for _, t in rows], percent=percent))
        for block in (jaccard_join.BLOCK, 16):
            assert sorted(map(tuple, jaccard_join.join_components(docs, percent=percent, block=block).collect())) == want


def test_least_forests():
    r = np.random.default_rng(4)
    far = jaccard_join.FAR
    for _ in range(20):
        m = int(r.integers(2, 30))
        cost = r.integers(0, 50, (m, m)).astype(np.int32)
        cost = np.minimum(cost, cost.T)
        cost[cost > 30] = far
        comp = r.integers(0, 6, m)
        open_ = {(i, j) for i in range(m) for j in range(i) if cost[i, j] < far and comp[i] != comp[j]}
        edges, left = jaccard_join._forests(cost, comp, 1)
        assert {(max(e), min(e)) for e in edges} <= open_ and left == (len(edges) < len(open_))
        every, left = jaccard_join._forests(cost, comp, 1000)
        assert {(max(e), min(e)) for e in every} == open_ and len(every) == len(open_) and not left

        def pieces_of(pairs):
            label = comp.copy()
            for a, b in pairs:
                label[label == label[a]] = label[b]
            return len(set(label.tolist()))

        assert pieces_of(edges) == pieces_of(open_)


def test_licenses(spark, odd):
    rows = [(1, "Code UNDER the MIT-License; under the mit license"), (2, "Apache License, Version 2.0"), (3, "CC BY-NC cc by"), (4, "mit dem under the mit"), (5, None)]
    out = licenses.summary(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out.collect()}
    assert got == {1: (9, 2, 1, 5, "mit"), 2: (5, 1, 0, 0, "apache-2"), 3: (5, 1, 0, 0, "cc-by-nc"), 4: (5, 0, None, None, ""), 5: (0, 0, None, None, "")}
    assert licenses.summary(licenses.scan(odd)).where("n_base > 0").count() == 0
    assert licenses.scan(odd.limit(0)).count() == 0


def test_contamination(spark, odd):
    r = random.Random(6)
    items = [(i, " ".join(f"q{r.randint(0, 999)}" for _ in range(r.randint(3, 40)))) for i in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        ws = [f"q{r.randint(0, 999)}" for _ in range(r.choice([3, 50, 800]))]
        if i % 3 == 0:
            cut = r.choice(items[:12])[1].split()
            if r.random() < 0.5:
                cut[0] = "changed"
            ws = ws[:20] + cut + ws[20:]
        rows.append((i, " ".join(ws)))
    rows.append((60, items[0][1].upper()))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def shingles(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    want = {(d, i) for d, t in rows for i, q in items if shingles(q) and 5 * len(shingles(q) & shingles(t)) >= 4 * len(shingles(q))}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(docs, bench).collect()}
    assert got == want and want
    assert {x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD) + 1
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0 and decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_items_with_null_ids_are_found(spark):
    item, other = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "x y z"), (3, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (4, other)], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["n_found"]) for x in decontaminate.contamination(docs, bench).collect())
    assert got == [(1, None, 8), (1, None, 8), (3, 4, 8)]
    assert [x["doc_id"] for x in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_nearest_vectors(spark):
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(1500, 16)), 4)
    x[100:160] = x[100]  # copies: ties go to the smaller id
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [1.0], 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = ann.search(table, F.col("vec_id") % 100 == 0, 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:10]) & set(found[q]))
    assert hits >= 0.9 * 150 and set(found) == set(range(0, 1500, 100)) and found[100] == list(range(101, 111))
    few = ann.search(table.where("vec_id < 4"), F.col("vec_id") == 0, 10).collect()
    assert len(few) == 3
    assert ann.search(table.limit(0), F.lit(True)).count() == 0


def test_queries_far_from_all_vectors(spark):
    g = np.random.default_rng(2)
    c = g.normal(size=(20, 16)) * 10
    x = c[g.integers(0, 20, 3000)] + g.normal(size=(3000, 16)) * 0.05
    x[::100] = (v := g.normal(size=(30, 16))) / np.linalg.norm(v, axis=1)[:, None] * 200
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0, 10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(found[q]) == 10
        hits += len(set(np.argsort(d)[:10].tolist()) & found[q])
    assert hits >= 0.9 * 300


def test_language_model(spark, odd):
    r = random.Random(8)
    ordered = [" ".join(f"{a} is after {b}" for a, b in [(r.choice("abcd"), r.choice("wxyz")) for _ in range(60)]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(ordered)), "doc_id long, text string").repartition(3)
    texts = docs.select("text")
    words = lm_score.vocabulary(texts)
    assert words.counts.sum() == 120 * 240
    trained = lm_score.train(texts, words)
    mean = lambda p, d: d.select(F.lit(0)).count() and lm_score.score(d, words, p).agg(F.avg("mean_log_prob")).first()[0]
    shuffled = spark.createDataFrame([(0, " ".join(r.sample(ordered[0].split(), 240)))], "doc_id long, text string")
    start = lm_score.Network.start(words.counts).flat
    assert mean(trained, docs) > mean(start, docs) + 0.05 and mean(trained, docs) > mean(trained, shuffled)
    net, tokens = lm_score.Network(trained), np.arange(8)
    every = np.repeat(lm_score.contexts(tokens, np.array([0, 8]), np.array([3])), lm_score.TOKENS, 0)
    assert np.exp(net.log_probabilities(every, np.arange(lm_score.TOKENS))).sum() == pytest.approx(1, abs=1e-3)
    out = {x["text"]: x for x in lm_score.score_corpus(odd).collect()}
    assert out[None]["log_prob"] == 0 and out[""]["mean_log_prob"] is None and out["same"]["n_tokens"] == 1
    assert lm_score.score_corpus(odd.limit(0)).count() == 0


def test_each_word_has_its_own_probability(spark):
    rare = lm_score.KNOWN + 300
    rows = [" ".join(f"k{i}" for i in range(lm_score.KNOWN)) for _ in range(8)] + [" ".join(f"r{i}" for i in range(rare) for _ in range(1 + i % 3))] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    words = lm_score.vocabulary(docs.select("text"))
    start = lm_score.Network.start(words.counts).flat
    assert words.counts.sum() == sum(len(t.split()) for t in rows)
    alone = [f"k{i}" for i in range(lm_score.KNOWN)] + [f"r{i}" for i in range(rare)]
    logs = {x["text"]: x["log_prob"] for x in lm_score.score(spark.createDataFrame([(w,) for w in [*alone, *alone[-9:], "unseen"]], "text string"), words, start).collect()}
    # All words of the corpus, and one unseen word for each shared number, add up to one.
    unseen = (np.exp(lm_score.Network(start).log_probabilities(np.full((lm_score.HASHED, 4), lm_score.PAD), np.arange(lm_score.KNOWN, lm_score.TOKENS))) / (words.counts[lm_score.KNOWN :] + 1)).sum()
    assert sum(np.exp(logs[w]) for w in alone) + unseen == pytest.approx(1, abs=1e-3)
    # Rarer is less likely, and known words are likelier than all of them.
    assert logs["unseen"] < max(logs[f"r{i}"] for i in range(rare)) < min(logs[f"k{i}"] for i in range(lm_score.KNOWN))
    full = lm_score.score(docs, words, start, ["doc_id"]).collect()
    assert len(full) == 10 and len({x["log_prob"] for x in full if x["doc_id"] >= 8}) == 1


def test_scores_are_sums_of_conditional_log_probabilities(spark):
    """Word by word from the parameters, with no code of the operator but the counts."""
    r = random.Random(4)
    rows = [" ".join(r.choice(["a", "b", "cc", "D", "e", f"x{r.randint(0, 9)}"]) for _ in range(r.randint(0, 60))) for _ in range(30)] + [None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    words = lm_score.vocabulary(docs.select("text"))
    net = lm_score.Network(lm_score.train(docs.select("text"), words))
    got = {x["doc_id"]: x for x in lm_score.score(docs, words, net.flat).collect()}
    for i, t in enumerate(rows):
        (s,) = text.slices(pa.array([t]))
        tokens = words.tokens(text.words(s, lower=True).hashes).tolist()
        total = 0.0
        for at, token in enumerate(tokens):
            h = np.zeros(lm_score.DIM)
            for k, d in enumerate((-2, -1, 1, 2)):
                near = tokens[at + d] if 0 <= at + d < len(tokens) else lm_score.PAD
                h += net.embed[near].astype(float) * net.place[k]
            h, group = np.tanh(h), token // lm_score.IN_GROUP
            for logits, own in ((h @ net.group + net.group_bias, group), (h @ net.word[group] + net.word_bias[group], token % lm_score.IN_GROUP)):
                total += logits[own] - np.log(np.exp(logits).sum())
        assert got[i]["n_tokens"] == len((t or "").split()) and got[i]["log_prob"] == pytest.approx(total, abs=1e-2)


def test_every_token_trains(spark):
    # A short text of words of its own: the parameters of each of its words change.
    rows = [f"a{i} b{i} c{i}" for i in range(30)]
    texts = spark.createDataFrame([(t,) for t in rows], "text string").repartition(1)
    words = lm_score.vocabulary(texts)
    start, trained = lm_score.Network.start(words.counts).flat, lm_score.train(texts, words)
    (s,) = text.slices(pa.array([" ".join(rows)]))
    number = words.tokens(text.words(s, lower=True).hashes)
    biases = lambda flat: lm_score.Network(flat).word_bias.reshape(-1)[number]
    assert (biases(trained) != biases(start)).all()
    # The same steps on all tokens give the same parameters.
    net, seen = lm_score.Network(start.copy()), np.zeros_like(start)
    w = text.words(next(text.slices(pa.array([r["text"] for r in texts.collect()]))), lower=True)
    net.step(lm_score.contexts(words.tokens(w.hashes), w.bounds, np.arange(90)), words.tokens(w.hashes), lm_score.RATE, seen)
    assert np.allclose(net.flat, trained, atol=1e-5)


def test_kept_words_digest():
    assert substring_dedup.brute_force(["a  b\n"]) == [(2, 0, hashlib.sha256(b"a b").hexdigest())]
