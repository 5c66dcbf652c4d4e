"""Block-max search against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import WORDS
from tidewright.llm import search
from tidewright.llm.common import cut, unpacked
from tidewright.llm.words import alnum_words


def brute(docs, items, k=10):
    own = [(d, Counter(alnum_words(t)), len(alnum_words(t))) for d, t in docs if alnum_words(t)]
    n_docs, terms = len(own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in own:
            m = 25 + 75 * n * n_docs // terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in alnum_words(text) if c[w])
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0))
        out += [(item_id, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(odd_texts):
    rng = random.Random(11)
    skewed = lambda n: " ".join(WORDS[int(len(WORDS) * rng.random() ** 3)] for _ in range(n))
    docs = [(i, t) for i, t in enumerate(odd_texts)] + [(1000 + i, skewed(rng.randint(1, 60))) for i in range(400)]
    docs += [(3000 - i, "w1 w2 w3 w390 Rare") for i in range(150)] + [(None, "w1 w399 w399"), (None, None), (1005, "w1 w2"), (9, skewed(6000))]
    items = [(1, "w1 w2 w2 rare w390"), (2, "RARE"), (2, "w5 w5 w5 w7"), (3, None), (4, "..."), (5, "nowhere"), (None, "w399 nowhere w1"), (7, skewed(50)), (8, "Wörld! x y ΣΑΣ")]
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 10])
def test_against_all_scores(spark, rows, k):
    docs, items = rows
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, score int, item_id int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    assert found(search.search(d, q, k)) == brute(docs, items, k)


def test_parts_of_items_and_small_blocks(spark, rows, monkeypatch):
    docs, items = rows
    monkeypatch.setattr(search, "WINDOW_BLOCKS", 3)
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    index = cut(spark, search.build_index(d, block_docs=5, block_terms=200), "index")
    assert found(search.search_index(index, q, item_bytes=300)) == brute(docs, items)


def test_no_rows(spark, rows):
    docs, items = rows
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    out = search.search(d, q.limit(0))
    assert found(out) == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(search.search(d.limit(0), q)) == []


def test_bounds_are_bounds_and_prune(spark, rows):
    docs, items = rows
    index = search.build_index(spark.createDataFrame([r for r in docs if r[1]], "doc_id bigint, text string").repartition(1), block_docs=8).collect()
    own = search.Items([t for _, t in items])
    corpus = search.Corpus(sum(r["n_docs"] for r in index), sum(r["n_terms"] for r in index))
    own.weigh(corpus, {})
    bounds, scored = [], []
    for r in index:
        block = search.Block(own, corpus, (r["head"], r["documents"], r["forward"]))
        bounds.append(own.bounds(unpacked(r["head"]), corpus))
        scored.append([int(block.scores(i).max()) for i in range(len(own))])
    bounds, scored = np.array(bounds), np.array(scored)
    assert (bounds >= scored).all()
    # the sorted bounds drop below the tenth score long before the last block, for an item with a rare word
    assert (bounds[:, 1] < np.sort(scored[:, 1])[-10]).mean() > 0.4


def test_long_lengths_stay_exact():
    big = search.Corpus(3 * 10**10, 2 * 10**13)
    n = np.array([7, 10**8], np.int64)
    assert big.norms(n).tolist() == [25 + 75 * x * big.docs // big.terms for x in n.tolist()]
