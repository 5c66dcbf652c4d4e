"""Near-duplicate operators and components against brute force."""

import random

import numpy as np
import pytest

from tests.llm.conftest import text_of
from tidewright.llm import embed_dedup, jaccard
from tidewright.llm.components import components
from tidewright.llm.words import lower_space_words


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute_documents(rows):
    sets = []
    for _, text in rows:
        w = lower_space_words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(range(len(rows)), links)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d e f"]
    passage = text_of(rng, 60)
    for _ in range(6):
        base = text_of(rng, rng.choice([12, 40, 150]))
        texts += [base, base, base.upper(), *(edited(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(12))]
    # a passage that many share, almost alone or among other words
    texts += [f"{passage} {text_of(rng, n)}" for n in [2, 3, 4, 5, 6, 8, 10, 100, 200, 300] * 2]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(None, texts[9]), (None, "alone without an identifier"), (3, "one"), (0, "one more text")]
    rng.shuffle(rows)
    return rows


def test_documents_match_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id bigint, text string, class string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr)
    assert got == brute_documents(corpus)


def test_documents_do_not_depend_on_table_sizes(spark):
    rng = random.Random(4)
    base = text_of(rng, 80)
    # a chain: each is near its neighbours, the ends are far from each other
    chain, words = [], base.split()
    for i in range(25):
        words[(i * 3) % 80] = f"new{i}"
        chain.append(" ".join(words))
    rows = list(enumerate(chain + [edited(rng, base, 1) for _ in range(40)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((tuple(r) for r in jaccard.join(docs, sketch_bits=4, filter_bits=4).collect()), key=repr)
    assert got == brute_documents(rows)


def test_long_lists_and_shared_hashes(spark, corpus, monkeypatch):
    # every list is long, all classes but the rarest are heavy, and some hashes of sets are shared
    monkeypatch.setattr(jaccard, "LONG", 3)
    monkeypatch.setattr(jaccard, "HEAVY", 0.02)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.join(docs, class_bits=5).collect()), key=repr) == brute_documents(corpus)


def test_long_lists_take_few_rounds(spark, monkeypatch):
    """Pipeline: executors hold what each round sends them, so there are few, and what is over is freed after each."""
    rounds, freed = [], []
    monkeypatch.setattr(jaccard, "components", lambda *a, f=jaccard.components: rounds.append(1) or f(*a))
    monkeypatch.setattr(jaccard, "free_dropped", lambda *a, f=jaccard.free_dropped: freed.append(1) or f(*a))
    docs = spark.createDataFrame([(i, f"the same five words here {i}") for i in range(100)], "doc_id bigint, text string")
    out = jaccard.join(docs, percent=50).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 2 for r in out) and len(out) == 100
    assert len(rounds) <= 3 and len(freed) > len(rounds)


def test_postings_that_pair_with_none_are_dropped(spark, monkeypatch):
    """op4: lists and the sets of their classes grew faster than the input, as more and more n-grams are shared by chance."""
    counts = {}
    monkeypatch.setattr(jaccard, "cut", lambda s, df, what, f=jaccard.cut: [out := f(s, df, what), counts.setdefault(what, out.count())][0])
    rng = random.Random(6)
    passage = text_of(rng, 30)
    rows = [(i, f"{passage} {text_of(rng, int(50 * 1.3**i) - 30)}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # the table has one cell, so n-grams are in no order of rarity
    assert sorted((tuple(r) for r in jaccard.join(docs, sketch_bits=0).collect()), key=repr) == brute_documents(rows)
    assert counts["lists"] == 0


def test_postings_with_partners():
    rng = np.random.default_rng(7)
    for size in (1, 2, 40, 400):
        rows = np.zeros(size, jaccard._POSTING)
        rows["gram"], rows["n"] = np.sort(rng.integers(0, 12, size)), rng.integers(5, 60, size)
        rows["pos"] = rng.integers(0, rows["n"] // 5 + 1)
        pairs = [(a, b) for a in range(size) for b in range(size) if a != b and rows["gram"][a] == rows["gram"][b]]
        n, left = rows["n"].astype(int).tolist(), (rows["n"] - rows["pos"]).astype(int).tolist()
        some = {a for a, b in pairs if 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and 180 * min(left[a], left[b]) >= 80 * (n[a] + n[b])}
        long = {a for a in range(size) if (rows["gram"] == rows["gram"][a]).sum() > jaccard.NEAR}
        assert set(np.flatnonzero(jaccard._partnered(rows, 80)).tolist()) == some | long


def test_documents_do_not_depend_on_compared_postings(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "NEAR", 2)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(2)
    assert sorted((tuple(r) for r in jaccard.join(docs, sketch_bits=4).collect()), key=repr) == brute_documents(corpus)


def test_packed_postings(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 500):
        rows = np.empty(n, jaccard._POSTING)
        for name, top in (("gram", 1 << 64), ("class", 1 << 63), ("n", 1 << 32), ("pos", 1 << 32)):
            rows[name] = rng.integers(0, top, n, np.uint64)
        rows.sort(order="gram")
        assert (jaccard._unpacked(jaccard._packed(rows)) == rows).all()


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = text_of(rng, 60_000)
    rows = [(1, long), (2, edited(rng, long, 40)), (3, "w1 " * 300_000), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + " y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr) == brute_documents(rows)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.join(none).collect() == []
    assert [tuple(r) for r in jaccard.join(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).collect()] == [(1, 0, 1)]


def test_keep_one_keeps_one_row_of_each_group(spark):
    # and one without an identifier
    rows = [(None, "a b c d e f g h")] * 30 + [(7, "h g f e d c b a x")] * 20 + [(None, "h g f e d c b a x"), (9, "h g f e d c b a x"), (3, "q r s t u v w x y"), (3, "other words that stand alone here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.keep_one(docs).collect()), key=repr) == sorted({rows[0], rows[30], rows[50], rows[52], rows[53]}, key=repr)


def test_keep_one_keeps_rows_without_identifier(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "z", "z")], "doc_id bigint, text string, lang string")
    assert sorted((tuple(r) for r in jaccard.keep_one(docs).collect()), key=repr) == [(2, "A b c d e f", "y"), (None, "z", "z")]


def test_keep_one_takes_any_columns(spark):
    names = ["row", "lead", "gone", "stays", "own", "id", "rank", "no_id", "class", "_row_number", "component_id"]
    rows = [(i, t, *range(len(names))) for i, t in ((1, "a b c d e f"), (2, "a b c d e f"), (3, "g"))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string", *(f"{n} int" for n in names)]))
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_parts_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 64, rng.integers(1, 900), np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        bound = np.abs(np.array(jaccard.parts_of(a)).view(np.uint16).astype(int) - np.array(jaccard.parts_of(b)).view(np.uint16).astype(int)).sum()
        assert bound <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(8)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]):
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        root = groups(nodes, [e for e in edges if e[0] in nodes and e[1] in nodes])
        want = {n: min(m for m in nodes if root[m] == root[n]) for n in nodes}
        rows = components(spark, df).collect()
        assert len(rows) == len(nodes) and {r["node"]: r["component"] for r in rows} == want


def brute_vectors(rows, threshold):
    def usable(v, label):
        return v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, n = [], [0] * len(rows)
    for i, (_, v, x) in enumerate(rows):
        for j in range(i):
            u, y = rows[j][1:]
            if x == y and usable(v, x) and usable(u, y) and len(u) == len(v):
                a, b = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links.append((i, j))
                    n[i], n[j] = n[i] + 1, n[j] + 1
    root, out = groups(range(len(rows)), links), []
    for i, (vec_id, _, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)
        out.append((vec_id, n[i], low, vec_id is not None and vec_id == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tile", "most", "heavy"), [(2048, 1 << 20, 0.002), (16, 0, 0.06)])
def test_vectors_match_brute_force(spark, monkeypatch, tile, most, heavy):
    monkeypatch.setattr(embed_dedup, "TILE_BYTES", most)
    monkeypatch.setattr(embed_dedup, "HEAVY", heavy)
    rng = np.random.default_rng(6)
    rows, number = [], 0
    for label in (1, 2):
        for _ in range(5):
            centre = rng.normal(size=12)
            for _ in range(9):
                rows.append((number * 2, (centre + rng.normal(size=12) * 0.25).astype(np.float32).tolist(), label))
                number += 1
    rows += [(1000 + i, rows[0][1], 1) for i in range(6)] + [(2000, [x * 3 for x in rows[0][1]], 1), (2001, [1.0] * 5, 1), (2002, [1.0] * 5, 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 12, 1), (3003, [None] + [1.0] * 11, 1), (3004, [float("nan")] * 12, 1), (3005, [float("inf")] * 12, 1)]
    rows += [(3006, rows[0][1], None), (3007, rows[0][1], None), (None, rows[0][1], 1), (None, [5.0, -1.0] * 6, 1), (0, rows[3][1], 1), (4000, [1e-30] * 12, 2), (4001, [1e30] * 12, 2)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id bigint, embedding array<float>, label int, v string").repartition(3)
    got = sorted((tuple(r) for r in embed_dedup.near_duplicates(df, tile=tile).collect()), key=repr)
    assert got == brute_vectors(rows, 0.93)


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 1500)) * rng.lognormal(size=(300, 1))
    unit = embed_dedup.units(v)
    t, exact = embed_dedup.Tile.of(unit), unit @ unit.T
    for threshold in (0.0, 0.02, 0.05):
        i, j = embed_dedup.possible(t, t, slice(0, 300), threshold)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert {tuple(p) for p in np.argwhere(exact >= threshold).tolist()} <= got
        assert len(got) < (exact >= threshold - 0.1).sum() + 1


@pytest.mark.parametrize("size", [64, 128, 1024, 2048, 4096])
def test_words_in_thue_and_morses_order(spark, size):
    """They collide in polynomial hashes modulo a power of two, whatever the base."""
    a = b"".join(b"ab"[bin(i).count("1") % 2 :][:1] for i in range(size)).decode()
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"X {b.upper()} y"), (6, f"{a}{b}"), (7, f"{b}{a}")]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()) == brute_documents(rows)
