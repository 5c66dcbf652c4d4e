"""Quality rules, language ID and chat formatting."""


import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, langid, quality


def brute_quality(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    covered, windows = set(), {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {x for i in at for x in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if __import__("re").search(r"[^\x20\x09-\x0D]", x):
            dup, seen = dup + (x in seen), seen | {x}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def exact_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail_is_exact():
    for n in (1, 5, 40, 300):
        for p in (0.001, 0.02, 0.5, 0.9):
            for k in {0, 1, n // 3, n - 1, n} & set(range(n + 1)):
                assert quality.binomial_tail(k, n, p) == pytest.approx(exact_tail(k, n, p), rel=1e-9, abs=1e-12)


def brute_cutoff(good, bad, alpha, level):
    best, gain, none = len(good), 0, len(good)
    for c in range(none - 1, 0, -1):
        g, b = int(good[c:].sum()), int(bad[c:].sum())
        if good.sum() == 0 or exact_tail(g, int(good.sum()), alpha) > level:
            break
        if b - quality.GOOD_COST * g > gain:
            best, gain = c, b - quality.GOOD_COST * g
    return best


def test_cutoffs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        good, bad = rng.poisson(40 * np.exp(-np.arange(12))), rng.poisson(4, 12)
        assert quality.cutoff(good, bad, 0.2, 0.01) == brute_cutoff(good, bad, 0.2, 0.01)
    assert quality.cutoff(np.zeros(5, int), np.ones(5, int), 0.1, 0.05) == 5


def test_false_rejections_stay_below_alpha():
    rng, misses = np.random.default_rng(4), 0
    share = 0.5 ** np.arange(1, 13)
    share /= share.sum()
    for _ in range(300):
        good, bad = rng.multinomial(400, share), rng.multinomial(4000, np.ones(12) / 12)
        c = quality.cutoff(good, bad, 0.1, 0.05)
        misses += share[c:].sum() >= 0.1
    assert misses <= 300 * 0.05 + 3 * math.sqrt(300 * 0.05)


def test_quality_against_brute_force(spark, docs, nothing):
    rng = random.Random(1)
    rows = [(i, r["text"], r["lang"]) for i, r in enumerate(docs.collect())]
    for i in range(1000, 1900):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", f"x{rng.randrange(1000)}"]) for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, "\n".join(" ".join(w + "###" * bad for w in words[k : k + 10]) for k in range(0, 60, 10)), "en" if i % 2 else None))
    rows.append((5000, "one two three four five six seven eight nine ten " * 6, "en"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = [(i, int(i % 3 != 0)) for i in range(1000, 1900)] + [(1000, None), (None, 1), (77777, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int").withColumns({"n_words": F.lit(1), "stratum": F.lit("x")})
    measured = quality.measure(df)
    cutoffs = {r["stratum"]: list(r["cutoffs"]) for r in quality.calibrate(measured, labels, alpha=0.12).collect()}
    assert set(cutoffs) == {"", "en"} and cutoffs["en"][0] <= quality.BINS
    got = quality.judge(measured, quality.calibrate(measured, labels, alpha=0.12)).collect()
    texts = {i: (t, x) for i, t, x in rows}
    measure_one = quality.Measurer()
    for r in got:
        text, lang = texts[r["doc_id"]]
        want = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r["doc_id"]
        over = [b >= c for b, c in zip(measure_one(text)[5], cutoffs[lang or ""], strict=True)]
        assert r["kept"] == (not want[5] and not any(over))
        assert r["kept"] or want[5] or r["rule"] == quality.SIGNALS[over.index(True)]
    by = {r["doc_id"]: r["kept"] for r in got}
    assert sum(by[i] for i in range(1000, 1900) if i % 3) > 590 and not any(by[i] for i in range(1000, 1900, 3) if i % 3 == 0)
    kept = quality.keep_good(df, quality.calibrate(measured, labels, alpha=0.12))
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k in by.items() if k)
    assert quality.judge(quality.measure(nothing), quality.calibrate(quality.measure(nothing), labels)).count() == 0


def joint_cutoffs(good, bad, alpha, level):
    """The turns of the joint way over bins (documents, signals), in memory: cutoffs, good documents of the steps, most."""
    bins, most = 21, quality.most_lost(len(good), alpha, level)
    cutoffs, swept, lost = np.full(good.shape[1], bins), [], 0
    while lost <= most:
        counts = [np.stack([np.bincount(x[(x < cutoffs).all(1), s], minlength=bins) for s in range(x.shape[1])]) for x in (good, bad)]
        s, c, fell = quality.sweep(*counts, swept, lost, most, np.zeros((2, good.shape[1])))
        if s < 0:
            break
        cutoffs[s], lost = c, lost + fell
        swept.append(s)
    return cutoffs


def test_joint_false_rejections_stay_below_alpha():
    rng, misses, used = np.random.default_rng(8), 0, 0
    share = 0.6 ** np.arange(1, 22)
    share /= share.sum()
    for _ in range(300):
        # all bad documents are far out in one signal, and near the good ones in others
        good, bad = rng.choice(21, (400, 3), p=share), np.minimum(20, rng.choice(21, (4000, 3), p=share) + rng.integers(0, 9, (4000, 3)))
        c = joint_cutoffs(good, bad, 0.1, 0.05)
        used += (c < 21).any()
        misses += 1 - np.prod([share[:x].sum() for x in c]) >= 0.1
    assert used > 290 and misses <= 300 * 0.05 + 3 * math.sqrt(300 * 0.05)


def test_most_lost():
    for n in (1, 50, 216, 300, 1000):
        for level in (0.0125, 0.05):
            assert quality.most_lost(n, 0.02, level) == max([k for k in range(min(n, 25)) if exact_tail(k, n, 0.02) <= level], default=-1)
    for strata in (1, 4, 30):
        n = quality.least_labels(strata, 0.02)
        assert quality.most_lost(n, 0.02, 0.05 / 2 / strata) == 0 and quality.most_lost(n - 1, 0.02, 0.05 / 2 / strata) == -1


def measured_rows(spark, rows):
    """Measured documents of (stratum, bins, quality), and their labels."""
    measured = [(i, x, 100, 500, 0, 0, 0, b) for i, (x, b, _) in enumerate(rows)]
    return spark.createDataFrame(measured, quality.SCHEMA), spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(rows)], "doc_id bigint, quality int")


def test_strata_with_few_labels_have_cutoffs(spark):
    rng, rows = random.Random(3), []
    for stratum, n in (("a", 300), ("b", 260), ("c", 251), ("d", 2500)):
        rows += [(stratum, [0, 0, 0, 3, 0, rng.randrange(60)], 1) for _ in range(n)]
        rows += [(stratum, [rng.randrange(20, 70), 0, 0, 3, 0, rng.randrange(60)], 0) for _ in range(40)]
        rows += [(stratum, [0, rng.randrange(30, 70), 0, 3, 0, rng.randrange(60)], 0) for _ in range(20)]
    measured, labels = measured_rows(spark, rows)
    judged = quality.judge(measured, quality.calibrate(measured, labels, alpha=0.02)).collect()
    assert {r["stratum"] for r in judged if r["certified"]} == {"a", "b", "d"} and quality.least_labels(4, 0.02) == 252 and quality.least_labels(4) == 201
    for stratum, caught in (("a", 60), ("b", 60), ("c", 0), ("d", 60)):
        own = [(r["kept"], rows[r["doc_id"]][2]) for r in judged if r["stratum"] == stratum]
        assert sum(not k for k, q in own if not q) == caught and all(k for k, q in own if q), stratum


def test_a_signal_that_costs_much_leaves_the_others_their_cutoffs(spark):
    # the first signal's lowest bad documents lie where a tenth of the good ones are: the joint way ends there
    rows = [("", [1 if i % 10 == 0 else 0, 0, 0, 0, 0, 0], 1) for i in range(4000)]
    rows += [("", [150 if i % 2 else 1, 0, 0, 0, 0, 0], 0) for i in range(100)] + [("", [0, 60, 0, 0, 0, 0], 0)] * 40
    measured, labels = measured_rows(spark, rows)
    assert quality.calibrate(measured, labels, alpha=0.02).first()["cutoffs"] == [150, 60, *[quality.BINS + 1] * 4]


def test_documents_that_fail_the_base_rules_are_not_counted(spark):
    # a tenth of the good documents are too short; their brevity is that of no document that passes
    words = [8 if i % 10 == 0 else 100 for i in range(600)] + [25] * 60
    measured = [(i, "", n, 500, 0, 0, 0, [0, 0, 0, 3, 0, int(quality.BINS / (1 + n / 10))]) for i, n in enumerate(words)]
    labels = spark.createDataFrame([(i, int(i < 600)) for i in range(660)], "doc_id bigint, quality int")
    measured = spark.createDataFrame(measured, quality.SCHEMA)
    cutoffs = quality.calibrate(measured, labels)
    assert cutoffs.first()["cutoffs"] == [*[quality.BINS + 1] * 5, int(quality.BINS / 3.5)]
    got = quality.judge(measured, cutoffs).where("not base_failed").collect()
    assert all(r["kept"] == (r["doc_id"] < 600) for r in got)


SYLLABLES = {"aa": ["ka", "ko", "ti", "mu"], "bb": ["sch", "ung", "ein", "ch"], "cc": ["tion", "eau", "ou", "re"]}


def made_up(rng, lang, n):
    return [("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return langid.train([(x, made_up(rng, x, 120)) for x in SYLLABLES for _ in range(25)])


def test_chains_in_blocks_are_exact(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    rng = np.random.default_rng(4)
    for k in (1, 3):
        lengths, t = np.array([1, 7, 8, 50, 3, 14, 29]), rng.normal(size=(k, k))
        e = rng.normal(size=(lengths.sum(), k)) * 3
        got = langid.chain_sums(np.exp(e), lengths, np.exp(t))
        for i, (n, start) in enumerate(zip(lengths, np.cumsum(lengths) - lengths, strict=True)):
            marginal, _, _ = langid.forward_backward(e[start : start + n][:, None, :], t)
            assert np.allclose(got[i], marginal.sum((0, 1)))


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3))
    marginal, pairs, log_z = langid.forward_backward(e, t)
    total = np.zeros((3, 3))
    for b in range(2):
        paths = {p: math.exp(sum(e[i, b, x] for i, x in enumerate(p)) + sum(t[x, y] for x, y in itertools.pairwise(p))) for p in itertools.product(range(3), repeat=4)}
        z = sum(paths.values())
        for i in range(4):
            for k in range(3):
                assert marginal[i, b, k] == pytest.approx(sum(w for p, w in paths.items() if p[i] == k) / z)
        for p, w in paths.items():
            for x, y in itertools.pairwise(p):
                total[x, y] += w / z
    assert np.allclose(pairs, total)


def test_documents_are_scored_alike_alone_and_together(model):
    rng = random.Random(5)
    texts = [" ".join(made_up(rng, rng.choice(list(SYLLABLES)), n)) for n in (1, 2, 50, 3, 700, 50)]
    together = langid.predict_texts(model, texts)
    for i, t in enumerate(texts):
        label, score = langid.predict_texts(model, [t])
        assert label == [together[0][i]] and score[0] == pytest.approx(together[1][i], abs=1e-5)
        e = model.emissions(langid.words_of(t)).astype(float)[:, None]
        sums = langid.forward_backward(e, model.transitions.astype(float))[0].sum(0)[0]
        assert sums.max() / len(e) == pytest.approx(score[0], abs=1e-4)


def test_languages(model):
    rng = random.Random(6)
    right = sum(langid.predict_texts(model, [" ".join(made_up(rng, x, 15))])[0] == [x] for x in SYLLABLES for _ in range(40))
    assert right >= 118
    # code-switched: more words of bb
    text = " ".join(made_up(rng, "aa", 10) + made_up(rng, "bb", 30))
    label, score = langid.predict_texts(model, [text])
    assert label == ["bb"] and 0.6 < score[0] < 0.9
    assert langid.predict_texts(model, [None, "", "12 %% ²"]) == (["und"] * 3, [0.0] * 3)


def test_long_runs_of_letters_are_read_whole(model):
    assert langid.words_of("ab " + "x" * 12 + " " + "abcdefghijklm") == ["ab", "x" * 12, "abcdef", "ghijklm"]
    rng = random.Random(12)
    for n in (13, 25, 400):
        run = "".join(made_up(rng, "bb", n))[:n]
        assert "".join(langid.words_of(run)) == run and max(map(len, langid.words_of(run))) <= langid.MOST_LETTERS
    for w in langid.words_of("abcdefghijkl" * 5):
        assert 9 + 2 * len(w) + 1 == (langid.features([w]) < langid.BUCKETS).sum()
    # the ends are of aa, what stands between of cc
    run = "".join(made_up(rng, "aa", 8))[:14] + "".join(made_up(rng, "cc", 60)) + "".join(made_up(rng, "aa", 8))[:15]
    assert langid.predict_texts(model, [run])[0] == ["cc"]


def test_words_of_many_lexicons_keep_them_all():
    languages = [f"l{i:02}" for i in range(20)]
    made = langid.Model(languages, {"abcdefghijkl": list(range(20)), "ab": [3, 19]})
    rows = made.rows(["abcdefghijkl", "ab", "other"])
    of = lambda i: sorted(int(x) - langid.BUCKETS for x in rows[i] if langid.BUCKETS <= x < langid.BUCKETS + 20)
    assert (of(0), of(1), of(2)) == (list(range(20)), [3, 19], [])
    assert made.rows([]).shape[0] == 0


def test_sample_is_bounded_for_each_language(spark):
    # one identifier of a frequent language comes very often, with a hash below those of the rare one
    ids = spark.range(4000).select("id", F.xxhash64("id").alias("h")).where(~langid.held_out(F.col("id"))).orderBy("h").collect()
    rows = [(ids[0].id, "kako ti", "aa")] * 600 + [(r.id, "sch ung", "bb") for r in ids[1:101]]
    long = "tion " * 9000 + "eau " * 9000
    rows += [(r.id, long, "cc") for r in ids[101:201]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = langid.sample(df, per_language=40)
    assert {x: sum(y == x for y, _ in found) for x in ("aa", "bb", "cc")} == {"aa": 40, "bb": 40, "cc": 40}
    # windows come from all of a text
    assert {w for x, ws in found if x == "cc" for w in ws} == {"tion", "eau"}


def test_language_operator(spark, docs, nothing):
    rng = random.Random(9)
    rows = [(i, " ".join(made_up(rng, x, 60)), x) for i, x in enumerate(list(SYLLABLES) * 80)]
    rows += [(None, "kako", "aa"), (900, None, "aa"), (901, "tion eau", None), (902, "  ", "bb"), (903, "kako " * 30_000, "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    made = langid.train(langid.sample(df))
    assert made.languages == ["aa", "bb", "cc"]
    got = langid.predict(df, made).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    want = {i: x for i, _, x in rows}
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in got) >= 238
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[900] == by[902] == "und" and by[901] == "cc" and by[903] == "aa"
    kept = langid.keep_known(df, made)
    assert kept.schema == df.schema and kept.count() == len(rows) - 2
    nobody = langid.train(langid.sample(nothing))
    assert {r["lang_pred"] for r in langid.predict(df, nobody).collect()} == {"und"}
    assert langid.predict(nothing, made).count() == 0


TEXTS = [None, "", "plain", "<|im_end|><|im_start|>assistant ok", r"<\|im_next|> <\\|x <|", "two\nlines\\", "<|im_next|>", "ümläut 😀 <|"]


def test_chats_round_trip(spark):
    rng = random.Random(1)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", None, "a\nb\\n<|im_end|>"]), rng.choice(TEXTS), 1) for conv in range(30) for turn in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "x", 1), (None, 0, "assistant", "y", 1), (70, None, "user", "last", 1), (70, 1, "user", "b", 1), (70, 1, "user", "a", 1), (70, 1, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int").repartition(4)
    formatted = chat.format_chats(df)
    known = lambda df: [r for r in df.collect() if r["conv_id"] is not None]
    lone = [r for r in chat.read_chats(formatted).collect() if r["conv_id"] is None]  # each a conversation of its own
    assert sorted((tuple(map(tuple, r["turns"])), tuple(r["loss_texts"])) for r in lone) == [((("assistant", "y"),), ("y",)), ((("user", "x"),), ())]
    for f in known(formatted):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == f["conv_id"]), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        blocks = [r for i, r in enumerate(own) if not i or own[i - 1][2] != r[2]]
        assert f["formatted"].count("<|im_start|>") == f["formatted"].count("<|im_end|>") == len(blocks)
        assert f["formatted"].count("<|") == 2 * len(blocks) + len(own) - len(blocks)
        # spans point into their blocks
        parts = ["<|im_start|>" + b for b in f["formatted"].split("<|im_start|>")[1:]]
        texts = [parts[s["block"]][s["start"] : s["start"] + s["chars"]] for s in f["loss_mask"]]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", t) for t in texts] == [x[3] for x in own if x[2] == "assistant"]
    for r in known(chat.read_chats(formatted)):
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [tuple(t) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss_texts"] == [x[3] for x in own if x[2] == "assistant"]
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_many_languages_and_late_evidence(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    # each of 70 languages has words of two letters of its own
    own = {f"l{i:02d}": [letters[i % 26] + letters[(i * 7 + i // 26 * 5 + 3) % 26] + letters[(i // 26 * 9 + k) % 26] for k in range(3)] for i in range(70)}
    rows = [(i * 70 + j, " ".join(rng.choice(words) + rng.choice(words) for _ in range(60)), x) for j, (x, words) in enumerate(own.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    samples = langid.sample(docs)
    assert {x for x, _ in samples} == set(own)
    model = langid.train(samples)
    assert len(model.languages) == 70
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert sum(out[i] == x for i, _, x in rows) > 0.95 * len(rows)
    # a text without a space, and one whose only letters stand behind 30,000 other characters
    run = "".join(rng.choice(own["l05"]) for _ in range(1700))
    late = "12 34 " * 5000 + " ".join(rng.choice(own["l33"]) + rng.choice(own["l33"]) for _ in range(30))
    assert len(run) > 5000 and langid.predict_texts(model, [run, late])[0] == ["l05", "l33"]


def test_training_windows_come_from_whole_texts(spark):
    late = "12 34 " * 5000 + "only here are letters"
    docs = spark.createDataFrame([(1, late, "en"), (3, late, "en"), (4, late, "en")], "doc_id bigint, text string, lang string")
    samples = langid.sample(docs)
    assert samples and all(w == ["only", "here", "are", "letters"] for _, w in samples)


def test_sparse_and_repeated_languages_are_learnt(spark):
    """A language whose rows have hardly any text, or one identifier, or are all copies, is in the sample."""
    rows = [(i, "eins zwei drei" if i % 300 == 0 else None, "de") for i in range(6000)]
    rows += [(10**6, f"un deux trois {i}", "fr") for i in range(3000)] + [(10**6 + 1, "uno dos tres", "es")] * 3000 + [(i, f"one two three {i}", "en") for i in range(7000, 9000)]
    rows += [(10**6 + 2, "123 ...", "xx")] * 10
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {x for x, _ in langid.sample(docs, 20)} == {"de", "fr", "es", "en"}
    assert {x for x, _ in langid.sample(docs.where("lang = 'es'"), 20)} == {"es"}


def test_many_short_rows_and_languages(monkeypatch):
    """Matrices are for chains of several blocks alone, some at a time; the sums are those of whole chains."""
    rng = np.random.default_rng(3)
    k = 24
    lengths = np.array([1] * 3000 + [langid.BLOCK * 5 + 3, 2, langid.BLOCK, langid.BLOCK * 3] + [1] * 100)
    p, a = rng.random((int(lengths.sum()), k)) + 0.01, rng.random((k, k)) + 0.1
    want, at = [], 0
    for n in lengths.tolist():
        own = np.log(p[at : at + n])[:, None, :]
        want.append(langid.forward_backward(own, np.log(a))[0].sum((0, 1)))
        at += n
    whole = langid.chain_sums(p, lengths, a)
    monkeypatch.setattr(langid, "MATRIX_CELLS", 3 * k * k)
    assert np.allclose(whole, np.array(want)) and np.allclose(langid.chain_sums(p, lengths, a), np.array(want))
