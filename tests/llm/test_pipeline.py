"""The pipeline against the same stages by brute force, on a small table."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from quadrille.llm import jaccard_join, pieces, substring_dedup  # noqa: E402


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(12)
    word = lambda: f"q{r.randint(0, 4000)}"
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)]
    shared = [word() for _ in range(60)]
    docs = {}
    for i in range(40):
        ws = [word() for _ in range(90)]
        if i % 8 == 1:
            ws[10:10] = shared
        if i % 8 == 2:
            ws[5:5] = items[i % 4][1].split()
        if i % 8 == 3:
            ws[7] = "idiot"
        if i % 8 == 4 and i > 4:
            ws = [*docs[4].split()[:-1], word()]
        docs[i] = " ".join(ws)
    docs[40], docs[41] = "", None
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in docs.items() if "idiot" not in (t or "").split()}
    found = jaccard_join.brute_force(list(left), list(left.values()))
    left = {i: left[i] for i, _, c in found if i == c}
    counts = {}
    for t in left.values():
        ws = (t or "").split()
        for k in range(len(ws) - 34):
            counts[tuple(ws[k : k + 35])] = counts.get(tuple(ws[k : k + 35]), 0) + 1
    kept = {}
    for i, t in left.items():
        ws = (t or "").split()
        gone = {k + d for k in range(len(ws) - 34) if counts[tuple(ws[k : k + 35])] > 1 for d in range(35)}
        kept[i] = " ".join(w for k, w in enumerate(ws) if k not in gone)
    runs = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    kept = {i: t for i, t in kept.items() if not any(5 * len(runs(q) & runs(t)) >= 4 * len(runs(q)) for _, q in items)}
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: model.encode(t) for i, t in kept.items()}

    assert sum(substring_dedup.brute_force(list(left.values()))[k][1] for k in range(len(left))) > 0 and len(want) < len(left) < 40
    got = {x["doc_id"]: list(x["ids"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_repeated_rows_leave_one_text(spark, tmp_path):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "mno"]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((str(x["doc_id"]), list(x["ids"])) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [("1", model.encode(texts[0])), ("4", model.encode(texts[2])), ("None", model.encode(texts[1]))]


def test_near_copies_with_few_edits_go(spark, tmp_path):
    ws = [f"z{i}" for i in range(96)]
    edited = [f"edit{i}" if i in (30, 60) else w for i, w in enumerate(ws)]
    docs = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(edited))], "doc_id long, text string")
    assert [x["doc_id"] for x in corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()] == [1]
