"""Secret scan against Python's regular expressions and a plain battery."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import queries, secret_scan

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_of(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng = random.Random(2)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    parts = ["password=", "Token: ", "api_key = '", "APIKEY:\"", "secret=", "passwd", "AKIA", " = ", "é", "\n", "𝒳", "tOkEn:abc ", "password=token: abcdefgh", "abcdef0123", "a.b=c-d", "K", "paſſword=abcdefgh"]
    mixed = ["".join(rng.choice(parts) if rng.random() < 0.6 else draw("0123456789abcdefABCDEFGXYZ+/_-", rng.randint(1, 30)) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    long = " ".join(f"AKIA{draw('ABCDEFGH234567', 16)} token={i:08d} é" for i in range(400))
    return [None, "", *odd_texts[:12], *mixed, long]


def test_base_spans(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, base string").repartition(3)
    out = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        want, r = base_of(t), out[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        got = r["spans"].split(",") if r["spans"] else []
        assert [s for s in got if not s.startswith("random_")] == [s for s in joined(want).split(",") if s]
        assert r["n_random"] == sum(s.startswith("random_") for s in got)
        for s in got:
            a, b = map(int, s.split(":")[1:])
            assert 0 <= a < b <= len(t)


def test_sql(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = df.toArrow()
    con = duckdb.connect()
    con.register("documents", rows)
    out = con.sql(queries.oracle_sql()["op11_secret_scan"])
    columns = out.columns
    assert sorted(out.fetchall()) == sorted(tuple(r[c] for c in columns) for r in secret_scan.scan(df).collect())


def test_p_of_random_runs(spark):
    """At most the share alpha of random runs has a p of alpha, and ordinary ones have small p."""
    rng = random.Random(7)
    for e in secret_scan.ENCODINGS:
        for n in (e.least, 64):
            rows = [("".join(rng.choice(e.alphabet) for _ in range(n)),) for _ in range(1500)]
            steps = [r[0] for r in spark.createDataFrame(rows, "s string").select(secret_scan.step_of(F.col("s"), e)).collect()]
            for alpha in (0.05, 0.01):
                share = sum(x >= -math.log10(alpha) * secret_scan.STEPS for x in steps) / len(steps)
                assert share <= alpha + 3 * math.sqrt(alpha / len(steps)), (e.name, n, alpha, share)
    base62 = secret_scan.ENCODINGS[3]
    plain = [("HTTPresponsestatuscodes404notfound",), ("aaaaaaaaaaaaaaaaaaaaB1",), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabc123",), ("theQuickestTestOfTheSetting1",)]
    assert all(r[0] >= 2 * secret_scan.STEPS for r in spark.createDataFrame(plain, "s string").select(secret_scan.step_of(F.col("s"), base62)).collect())


def test_added_spans(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice(secret_scan.ENCODINGS[4].alphabet) for _ in range(40)) for _ in range(60)]
    keys = [k for k in keys if re.search("[+/]", k) and all(re.search(c, k) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
    plain = [f"/srv/data/Chapter{i}/SectionOfTheManual" for i in range(200)]
    rows = [(i, f"see {k}== now") for i, k in enumerate(keys)] + [(1000 + i, f"see {p} now") for i, p in enumerate(plain)]
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(out[i] == "random_base64:4:46" for i in range(len(keys))) >= 0.9 * len(keys)
    assert sum(bool(out[1000 + i]) for i in range(len(plain))) <= 0.05 * len(plain)


def test_no_rows_and_plan(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert secret_scan.scan(df).collect() == []
    plan = secret_scan.found_in(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
