"""Cross-tokenizer alignment against whole texts encoded by both libraries."""

import hashlib
import os
import random
from collections import Counter

import pytest

from tidewright.llm import align, queries
from tidewright.llm.encode import byte_chars

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths(path):
    return path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def brute(rows, paths):
    """rows(doc_id, text), each text encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_lib.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_chars())}

    def bytes_a(i):
        return bytes(byte[c] for c in a_lib.id_to_token(i))

    def bytes_b(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def ended(ids, of):
        out, at = {}, 0
        for i in ids:
            at += len(of(i))
            out[at] = i
        return out

    def cut_at(ids, ends):
        out, now, ends = [], [], set(ends)
        for e, i in ids.items():
            now.append(str(i))
            if e in ends:
                out.append(",".join(now))
                now = []
        return out

    count, per = Counter(), []
    for doc_id, text in rows:
        a, b = {}, {}
        if text:
            ids_a, ids_b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            if b"".join(map(bytes_a, ids_a)) == (" " + text).encode() == b"".join(map(bytes_b, ids_b)):
                a, b = ended(ids_a, bytes_a), ended(ids_b, bytes_b)
        both = [e for e in a if e in b]
        links = [(a[e], b[e]) for e in both]
        groups = [f"{x}|{y}" for x, y in zip(cut_at(a, both), cut_at(b, both), strict=True)]
        count.update(links)
        per.append((doc_id, len(a), len(b), groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return sorted(
        (
            doc_id, na, nb, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "",
        )
        for doc_id, na, nb, groups, links in per
    )


def aligned(df, paths):
    return sorted(tuple(r) for r in align.align_documents(df, *paths, texts=False).collect())


def test_odd_texts(spark, paths, odd_texts, monkeypatch):
    rng = random.Random(3)
    rows = [None, "", " ", "\n", " \n x", "<|endoftext|> <s> <0x0A>", "x\r\ny;\r z  b  \n", "▁a b", "x" * 3000, "one\x1ctwo \x85 three\xa0 four"]
    rows += ["".join(rng.choice("ab;.\n\r\t    é'") for _ in range(60)) for _ in range(200)]
    rows = list(enumerate([t for t in rows + odd_texts if len(t or "") < 5000]))
    rows += [(3, "same"), (3, "same")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, segment string, no int").repartition(3)
    want = brute(rows, paths)
    assert aligned(df, paths) == want
    # chunks of a few documents give the same
    monkeypatch.setattr(align, "CHUNK_BYTES", 300)
    monkeypatch.setattr(align, "HELD", 50)
    assert aligned(df, paths) == want


def test_nulls_and_no_rows(spark, paths):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id bigint, text string")
    out = align.align_documents(df, *paths).collect()
    assert sorted((r["n_a"], r["n_groups"], r["count_sum"], r["groups"]) for r in out if r["doc_id"] is None) == [(0, 0, 0, ""), (2, 2, 4, "257|264;275|287")]
    assert aligned(df.limit(0), paths) == []


def test_cuts_are_certain(paths):
    both = align.pair(*paths)
    assert both.cutting == " \n\t"
    # some pieces end with a carriage return, so that is no place to cut
    assert both.segments("a;\r\nb c\rd") == [" a;\r\nb", " c\rd"]
    assert "".join(both.segments("a \xa0 b\n\n c")) == " a \xa0 b\n\n c"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_registered_query(spark, paths):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], paths)
    out = queries.queries()["op13_cross_tokenizer_alignment"](spark, SF)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == want
