"""The corpus pipeline against its stages by brute force."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import brute_documents, edited
from tests.llm.test_models import brute_quality
from tests.llm.test_text_operators import check_packing, ids_of
from tidewright.llm import langid, packing, quality

LANGS = {"en": ["the", "and", "thing", "with", "house", "over", "rain", "other"], "de": ["und", "nicht", "haus", "regen", "schon", "über", "ein", "das"]}


def test_pipeline(spark, tmp_path, path):
    rng, rows, labels = random.Random(11), [], []
    for i in range(420):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(LANGS[lang]) + rng.choice(["", "", f"{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}"]) for _ in range(rng.randrange(25, 90))]
        bad = i % 7 == 0
        rows.append((i * 2, " ".join(w + "###" * bad for w in words), lang))
        labels.append((i * 2, 0 if bad else 1))
    rows += [(1001 + 2 * k, rows[k][1], "en") for k in range(1, 9)] + [(1101 + 2 * k, edited(rng, rows[40 + k][1] + " " + rows[41 + k][1], 1), "de") for k in range(5)]
    rows += [(2001, None, "en"), (2003, "", None), (2005, "12 34 " * 30, "de"), (2007, "too short", "en"), (2009, "over and over again we say it now " * 10, None), (None, rows[5][1] + " unseen", "en")]
    spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(langid.sample(docs))
    langs, scores = langid.predict_texts(model, [t for _, t, _ in rows])
    kept = [r for r, x, s in zip(rows, langs, scores, strict=True) if x != "und" and s >= langid.LEAST_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {2001, 2003, 2005}
    measured = quality.measure(spark.createDataFrame(kept, "doc_id bigint, text string, lang string"))
    cutoffs = {r["stratum"]: r["cutoffs"] for r in quality.calibrate(measured, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    one, none = quality.Measurer(), [quality.BINS + 1] * len(quality.SIGNALS)
    kept = [r for r in kept if not brute_quality(r[1])[5] and all(b < c for b, c in zip(one(r[1])[5], cutoffs.get(r[2] or "", none), strict=True))]
    leads = {i: low for i, _, low in brute_documents([(i, t) for i, t, _ in kept])}
    kept = [r for r in kept if r[0] is None or leads[r[0]] == r[0]]
    assert 300 < len(kept) < 430 and not {1003, 1005, 2007, 2009} & {r[0] for r in kept}

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = [(i, ids_of(library, t) + (1).to_bytes(4, "little")) for i, t, _ in kept]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in kept}
    check_packing(got, want, packing.Limits())
    assert sum(r["length"] for r in got) == sum(len(np.frombuffer(i, "<u4")) for _, i in want)


def test_stages_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls everywhere, copies without identifiers, a very long text, and columns with the names that stages use inside."""
    long = " ".join(f"the thing {i} and rain" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, long, "en", "s", 1), (None, long, None, None, None), (2, "the thing and the rain " * 9, "en", "s", 2), (3, "", "", "", 0), (3, "", "", "", 0)]
    names = ["gone", "row", "stratum", "cutoffs", "_cutoffs", "h", "class", "component", "language", "lead"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{n} int" for n in names)]))
    spark.createDataFrame([(None, None, 0), (1, 1, None), (1, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        docs.write.mode("overwrite").parquet(at := str(tmp_path / stage.__name__))
        docs = spark.read.parquet(at)
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} == {1, None}
    assert sum(r["length"] for r in packing_rows(spark, docs, tmp_path)) > 200_000


def packing_rows(spark, docs, tmp_path):
    return corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
