"""License scan, encoding, token counts, shards and packing against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from tidewright.llm import bpe, license_scan, packing, sstable, wordpiece
from tidewright.llm.common import new_path
from tidewright.llm.encode import library_encoder
from tidewright.llm.words import lower_space_words


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path("word_bpe_49k.json"))


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_license_phrases_and_templates():
    scan = license_scan.Scanner().scan
    assert scan(None) == (0, 0, None, None, "", "", 0.0)
    assert scan("") == scan(" .. ")
    n, places, first, last, base, labels, score = scan("x The MIT License. mit-license, Released under the MIT License.")
    assert (n, places, first, last, base, labels, score) == (11, 3, 2, 9, "mit", "mit,mit-notice", 1.0)
    assert scan("the mit licence")[1] == 0
    # optional region left out or present; a replaceable region of up to two words
    for t in ("licensed under the gnu general public license", "this work is licensed under the GNU General Public License, version 3 or", "Program is licensed under the gnu general public license version 2 1"):
        assert "gpl-notice" in scan(t)[5].split(","), t
    assert "gpl-notice" not in scan("licensed under a gnu general public license")[5]
    body = license_scan.TEMPLATES["mit"].replace("{?including the next paragraph?}", "").replace("{holders:12}", "the authors or copyright holders")
    assert scan(body)[5] == "mit"
    assert scan(body.replace("sublicense", "relicense"))[5] == ""
    assert scan(body.replace("authors or", "a b c d e f g h i j k"))[5] == ""


def test_automata_agree_with_regular_expressions():
    import random

    rng = random.Random(2)
    template = "a {?b {?c?}?} {x:2} d {?e?} a"
    auto, pattern = license_scan.Automaton(license_scan.parse(template)), re.compile(license_scan.template_regex(template))
    for _ in range(3000):
        words = [rng.choice("abcdexy") for _ in range(rng.randrange(9))]
        joined = "".join(f"|{w}|" for w in words)
        for i in range(len(words)):
            assert auto.accepts([w.encode() for w in words], i) == bool(pattern.match(joined, 3 * i)), words


def test_license_query_rows(docs, nothing):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.count()
    for r, t in zip(sorted(rows, key=repr), sorted(rows, key=repr), strict=True):
        assert r == t
    assert license_scan.scan(nothing).count() == 0


def test_codec_is_the_library(docs, nothing, path, library):
    p = path("word_bpe_49k.json")
    want = []
    for r in docs.collect():
        ids = ids_of(library, r["text"])
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert key(bpe.digest_documents(docs, p).collect()) == key(want)
    back = bpe.encode_documents(docs.where("doc_id = 4"), p).first()
    assert np.frombuffer(bytes(back["ids"]), "<u4").tolist() == library.encode("Hello, Wörld! it's 42 <|endoftext|> x", add_special_tokens=False).ids
    assert bpe.digest_documents(nothing, p).count() == 0


def test_forced_boundaries_are_certain(path):
    c = bpe.codec(path("word_bpe_49k.json"))
    assert len(c.cuts("the")) == 1
    assert "".join(c.cuts("qqxzjq")) == "qqxzjq" and len(c.cuts("qqxzjq")) > 2


def test_small_memories_change_nothing(path, library, odd_texts):
    from tidewright.llm.encode import LibraryEncoder

    small = LibraryEncoder(path("word_bpe_49k.json"), most=5)
    texts = odd_texts[:40]
    assert small.batch(texts) == [ids_of(library, t) for t in texts]
    assert len(small.chunks) <= 5
    assert library_encoder(path("word_bpe_49k.json")).batch(texts) == small.batch(texts)


def test_counts_are_greedy_word_pieces(docs, nothing, path):
    p = path("byte_bpe_50k.json")
    begin, go_on = wordpiece.vocabulary(p)
    names = [f"{b.decode('latin1')}" for b in begin] + [f"##{b.decode('latin1')}" for b in go_on] + ["[UNK]"]
    model = models.WordPiece({w: i for i, w in enumerate(dict.fromkeys(names))}, unk_token="[UNK]", max_input_chars_per_word=10**9)
    auto = wordpiece.LongestMatch(begin, go_on)
    words = {w for r in docs.collect() for w in lower_space_words(r["text"])} | {b"unaffable", b"zzzzqqqq", "日本語".encode(), b"\xff"}
    for w in words:
        assert auto.pieces(w) == len(model.tokenize(w.decode("latin1"))), w
    small = wordpiece.LongestMatch({b"a", b"abcd"}, {b"b", b"c", b"cd", b"bcz"})
    assert [small.pieces(w) for w in (b"", b"a", b"abcd", b"abcx", b"abc", b"abcz", b"b", b"abcdb", b"abccd")] == [0, 1, 1, 1, 3, 2, 1, 2, 4]
    rows = {r["doc_id"]: r for r in wordpiece.count_tokens(docs, p).collect()}
    assert rows[0]["n_tokens"] == 0 and rows[3]["n_words"] == 1
    assert wordpiece.count_tokens(nothing, p).count() == 0


def test_shards_of_many_null_and_equal_identifiers(spark, path, library, tmp_path):
    """Hot identifiers, and equal rows of one, are dealt over several tasks."""
    rows = [(None, f"null {i}") for i in range(3000)] + [(7, f"seven {i % 5}") for i in range(3000)] + [(i, "x") for i in range(300)]
    docs, out = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), f"file://{tmp_path}/hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task
    try:
        manifest = sstable.write_shards(docs, path("word_bpe_49k.json"), out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) == 4 and max(m["docs"] for m in manifest) < 3000
    back = sorted(sstable.read_shards(spark, out).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in back) == sorted((i is not None, i or 0, ids_of(library, t) + (1).to_bytes(4, "little")) for i, t in rows)
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in back]
    assert keys == sorted(keys) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:], strict=False))
    assert len(sstable.look_up(out, None)) == 3000 and len(sstable.look_up(out, 7)) == 3001


def test_shards_round_trip_and_look_up(spark, docs, nothing, path, library):
    p, out = path("word_bpe_49k.json"), new_path(spark, "test")
    manifest = sstable.write_shards(docs, p, out)
    assert sum(m["docs"] for m in manifest) == docs.count()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(library, text) + (1).to_bytes(4, "little")
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert key(tuple(r)[:4] + (bytes(r["ids"]),) for r in sstable.read_shards(spark, out).collect()) == key(want)
    for doc_id in (0, 4, 7, None):
        assert [x.tobytes() for x in sstable.look_up(out, doc_id)] == [w[4] for w in want if w[0] == doc_id]
    assert len(sstable.look_up(out, 8)) == 2
    assert sstable.look_up(out, 10**12) == [] and sstable.look_up(out, -5) == []
    # a task begins another shard once one is full
    small = new_path(spark, "test")
    many = sstable.write_shards(docs, p, small, shard=1000)
    assert len(many) > len(manifest) and {m["shard"][:12] for m in many} == {m["shard"][:12] for m in manifest}
    assert key(tuple(r)[:4] + (bytes(r["ids"]),) for r in sstable.read_shards(spark, small).collect()) == key(want)
    assert [x.tobytes() for x in sstable.look_up(small, 7)] == [w[4] for w in want if w[0] == 7] and len(sstable.look_up(small, 8)) == 2
    empty = new_path(spark, "test")
    assert sstable.write_shards(nothing, p, empty) == [] and sstable.read_shards(spark, empty).count() == 0


def test_shard_of_many_blocks():
    import io

    sink = io.BytesIO()
    w = sstable.ShardWriter(sink, 4)
    ids = [-(1 << 63), -7, 0, *range(10, 5000), (1 << 63) - 1]
    for i in ids:
        w.add(sstable.key_of(i), np.full(20, i & 0xFFFF, "<u4").tobytes())
    with pytest.raises(ValueError, match="ascend"):
        w.add(sstable.key_of(0), b"")
    w.close()
    r = sstable.ShardReader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    assert len(r.blocks) > 3 and [sstable.id_of(k) for k, _ in r.scan()] == ids
    assert all(r.get(i)[0].tolist() == [i & 0xFFFF] * 20 for i in (-7, 10, 4999, 2500))
    assert sum(r.may_hold(sstable.key_of(i)) for i in range(10_000, 20_000)) < 300
    with pytest.raises(ValueError, match="damaged"):
        bad = bytearray(sink.getvalue())
        bad[-sstable.FOOTER.size - 1] ^= 1
        sstable.ShardReader(io.BytesIO(bytes(bad)), len(bad))


def check_packing(rows, want, limits):
    """Every id lies in one piece; sequences are gapless, within the limits, and little padded."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for group in by_sequence.values():
        group.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in group] == [sum(x["length"] for x in group[:i]) for i in range(len(group))]
        total = sum(r["length"] for r in group)
        assert len(group) <= limits.segments and total <= limits.tokens
        assert total == limits.tokens or total & (total - 1) == 0
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert sum(p[3] for p in pieces) == sum(len(i) // 4 for _, i in want)
    ids = {}
    for doc_id, i in want:
        ids.setdefault((doc_id is None, doc_id or 0), []).append(i)
    for none, doc_id, start, length, crc in pieces:
        assert any(zlib.crc32(i[4 * start : 4 * (start + length)]) == crc for i in ids[none, doc_id])
    for (doc_id, n), group in by_doc.items():
        covered = sorted(x for r in group for x in range(r["start"], r["start"] + r["length"]))
        copies = len(covered) // n
        assert covered == sorted(list(range(n)) * copies), doc_id


def test_packing(docs, nothing, path, library):
    p, want = path("word_bpe_49k.json"), []
    for r in docs.collect():
        want.append((r["doc_id"], ids_of(library, r["text"]) + (1).to_bytes(4, "little")))
    for limits in (packing.Limits(), packing.Limits(256, 3, 256), packing.Limits(512, 64, 300)):
        check_packing(packing.pack(docs, p, limits=limits).collect(), want, limits)
    assert packing.pack(nothing, p).count() == 0


def test_packer_keeps_loss_limit():
    limits = packing.Limits(128, 8, 60)
    rng = np.random.default_rng(0)
    packer, lengths = packing.Packer(limits), rng.integers(2, 90, 500)
    froms = rng.integers(0, lengths)
    packer.add([(i, 0, int(n), int(f)) for i, (n, f) in enumerate(zip(lengths, froms, strict=True))])
    seen, used, room = {}, 0, 0
    for pieces in packer.sequences(last=True):
        assert len(pieces) <= 8 and sum(p[2] for p in pieces) <= 128
        assert sum(max(0, s + n - max(s, froms[e])) for e, s, n in pieces) <= 60
        used, room = used + sum(p[2] for p in pieces), room + 1
        for e, s, n in pieces:
            seen.setdefault(e, []).extend(range(s, s + n))
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(lengths))
    assert used == lengths.sum()


def test_codecs_remember_as_much_as_their_query_says():
    """op3: a worker that does nothing else remembered as little as the pipeline's; what is remembered changes no ids."""
    from tidewright.llm import bpe, queries

    path = queries.tokenizer_path()
    small, large = bpe.codec(path, 3), bpe.codec(path, queries.REMEMBER)
    assert small is bpe.codec(path, 3) and small is not large and large.chunks.most == large.words.most == 400_000
    for text in ("don't stop, it's 42 of 1999!", "word word other_word x1y2", "ÄÖ über-straße's", "<|im_end|> a\x1cb", "", None):
        ids = large.encode(text)
        assert ids == small.encode(text) == large.encode(text) and large.decode(ids) == small.decode(ids)
        assert ids == b"".join(i.to_bytes(4, "little") for i in large.library.encode(text or "", add_special_tokens=False).ids)
