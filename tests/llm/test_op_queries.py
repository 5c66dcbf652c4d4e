"""The registered opN_ queries at the smallest scale, against their SQL or brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_models import brute_quality
from tests.llm.test_text_operators import check_packing, ids_of
from tidewright.llm import langid, packing, queries, wordpiece
from tidewright.llm.words import lower_space_words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return con.sql("select doc_id, text, lang from documents").fetchall()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("word_bpe_49k.json"))


def run(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    by = {r["doc_id"]: r for r in rows if "doc_id" in r}
    assert not by or name.startswith("op10") or len(by) == len(rows)
    return rows, by


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    out = con.sql(queries.oracle_sql()[name])
    columns = list(out.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns) and sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_bpe_codec(spark, texts, library):
    _, by = run(spark, "op3_bpe_codec")
    for doc_id, text, _ in texts:
        ids = ids_of(library, text)
        back = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert tuple(by[doc_id]) == (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_quality_rules(spark, texts):
    _, by = run(spark, "op5_quality_rules")
    for doc_id, text, _ in texts:
        r = by[doc_id]
        assert tuple(r)[1:7] == brute_quality(text) and not (r["base_failed"] and r["kept"])


def test_sorted_string_tables(spark, texts, library):
    _, by = run(spark, "op6_sorted_string_tables")
    start = 0
    for doc_id, text, _ in sorted(texts):
        ids = ids_of(library, text) + (1).to_bytes(4, "little")
        assert tuple(by[doc_id]) == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_counts(spark, texts, path):
    _, by = run(spark, "op7_token_counts")
    begin, go_on = wordpiece.vocabulary(path("byte_bpe_50k.json"))

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (go_on if at else begin)), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    for doc_id, text, _ in texts:
        words = lower_space_words(text)
        assert tuple(by[doc_id]) == (doc_id, len(words), sum(map(greedy, words)))


def test_language_id_learns_from_no_held_out_row(spark, texts, tmp_path):
    _, by = run(spark, "op9_language_id")
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in texts}
    assert {i: r["held_out"] for i, r in by.items()} == out
    right = [by[i]["lang_pred"] == lang for i, _, lang in texts if out[i]]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r["score"] <= 1 for r in by.values())
    # other languages in the held-out rows, and other texts there, change no prediction of the rest
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    gone = langid.held_out(F.col("doc_id"))
    other = docs.withColumns({"lang": F.when(gone, "xx").otherwise(F.col("lang")), "text": F.when(gone, "qq ww zz").otherwise(F.col("text"))})
    assert langid.sample(other) == langid.sample(docs)


def test_packing_by_three_limits(spark, texts, library):
    rows, _ = run(spark, "op10_packing")
    want = [(i, ids_of(library, t) + (1).to_bytes(4, "little")) for i, t, _ in texts]
    check_packing(rows, want, packing.Limits())
    # each of the three limits is reached
    prompt = {i: len(ids_of(library, packing.first_line(t or ""))) // 4 for i, t, _ in texts}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    tokens = [sum(r["length"] for r in s) for s in sequences.values()]
    loss = [sum(max(0, r["start"] + r["length"] - max(r["start"], prompt[r["doc_id"]])) for r in s) for s in sequences.values()]
    limits = packing.Limits()
    assert max(loss) <= limits.loss_tokens and max(map(len, sequences.values())) <= limits.segments
    assert max(tokens) == limits.tokens and max(loss) == limits.loss_tokens
    alone = np.array(tokens)
    assert ((alone & (alone - 1)) == 0).all()


def test_each_limit_ends_sequences(texts, library):
    packer = packing.Packer(packing.Limits())
    sizes = [(n, 0, len(ids_of(library, t)) // 4 + 1, len(ids_of(library, packing.first_line(t or ""))) // 4) for n, (_, t, _) in enumerate(texts * 12)]
    for at in range(0, len(sizes), packing.WINDOW):
        packer.add(sizes[at : at + packing.WINDOW])
        for _ in packer.sequences():
            pass
    for _ in packer.sequences(last=True):
        pass
    # the loss limit shapes sequences without leaving them short: they come to it and to the token limit at once
    assert all(n > 0 for n in packer.reached.values()) and packer.ended["segments"] > 0, (packer.reached, packer.ended)


def test_few_sequences(spark, texts, library):
    """At most 5 % more than the tokens need, in one task."""
    docs = spark.createDataFrame([(i, t) for n in range(12) for i, t, _ in texts], "doc_id bigint, text string").coalesce(1)
    from pyspark.sql import functions as F

    out = packing.pack(docs, queries.tokenizer_path()).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert out["n"] <= 1.05 * out["tokens"] / packing.Limits().tokens + 2
