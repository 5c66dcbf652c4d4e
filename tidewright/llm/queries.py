"""The opN_ queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, embed_dedup, jaccard, langid, license_scan, packing, quality, search, secret_scan, sstable, wordpiece
from .common import cut, new_path


#: Chunks that a worker remembers where it does nothing but encode, some 80 MB a generation; the pipeline's workers remember fewer.
REMEMBER = 400_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path(), REMEMBER)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(spark, quality.measure(table(spark, sf_dir, "documents")), "measured")
    cutoffs = cut(spark, quality.calibrate(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judge(measured, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "certified")


def op6_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "shards")
    sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), out, remember=REMEMBER)
    return sstable.read_shards(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    back = chat.read_chats(chat.format_chats(rows.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(langid.sample(docs)))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), remember=REMEMBER)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scan, op2_embedding_near_dedup, op3_bpe_codec, op4_ngram_jaccard_join, op5_quality_rules,
        op6_sorted_string_tables, op7_token_counts, op8_chat_format, op9_language_id, op10_packing,
        op11_secret_scan, op12_lexical_search, op13_cross_tokenizer_alignment,
    )}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses() -> str:
    def words(x: str) -> str:
        return f"((length({x}) - length(replace({x}, '|', ''))) // 2)"

    def wrapped(phrase: str) -> str:
        return "".join(f"|{w}|" for w in phrase.split())

    base = license_scan.BASE
    count = " + ".join(f"(length(s) - length(replace(s, '{wrapped(p)}', ''))) // {len(wrapped(p))}" for p in base)
    first = ", ".join(f"case when contains(s, '{wrapped(p)}') then {words(f'''string_split(s, '{wrapped(p)}')[1]''')} end" for p in base)
    last = ", ".join(f"case when contains(s, '{wrapped(p)}') then n_words - {len(p.split())} - {words(f'''string_split(s, '{wrapped(p)}')[-1]''')} end" for p in base)
    labels = ", ".join(f"case when contains(s, '{wrapped(p)}') then '{x}' end" for p, x in base.items())
    more = ", ".join(f"case when regexp_matches(s, '{license_scan.template_regex(t)}') then '{x}' end" for x, t in license_scan.TEMPLATES.items())
    listed = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x is not null))), ',')"
    return f"""
        with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
        t as (select doc_id, len(ws) as n_words, case when len(ws) = 0 then '' else '|' || array_to_string(ws, '||') || '|' end as s from w),
        u as (select *, [{labels}] as base, [{more}] as more from t)
        select doc_id, n_words::bigint as n_words, ({count})::bigint as n_base, least({first})::bigint as first_word,
          greatest({last})::bigint as last_word, coalesce({listed.format('base')}, '') as base_labels,
          coalesce({listed.format('list_concat(base, more)')}, '') as labels,
          case when len(list_filter(more, lambda x: x is not null)) > 0 then 1.0::double
               when len(list_filter(base, lambda x: x is not null)) > 0 then 0.5::double else 0.0::double end as score
        from u"""


_EMBEDDINGS = """
    with recursive good as (
      select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from good a join good b
      on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    least_ as (select a, min(b) as low from reach group by a),
    n as (select a, count(*) as n from links group by a)
    select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
      vec_id = least(vec_id, coalesce(low, vec_id)) as kept
    from embeddings left join n on n.a = vec_id left join least_ on least_.a = vec_id"""

_JACCARD = rf"""
    with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
    g as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n from g group by doc_id),
    both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
    half as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
    links as (select a, b from half union all select b, a from half),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    least_ as (select a, min(b) as low from reach group by a)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id
    from documents d left join n using (doc_id) left join least_ on least_.a = d.doc_id"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_CHATS = rf"""
    with rows_ as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    k as (select *, case when conv_id is null then row_number() over () end as alone from rows_),
    t as (select *, role is distinct from lag(role) over (partition by conv_id, alone order by turn nulls first, role, text) as starts from k),
    c as (select conv_id, count(*) as n_turns,
      string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
      coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
      sum(length({_ESCAPED.format("text")}) + case when starts
        then length('<|im_start|>' || {_ESCAPED.format(r"replace(replace(role, '\', '\s'), chr(10), '\n')")} || chr(10)) + length('<|im_end|>' || chr(10))
        else length('<|im_next|>') end) as chars
      from t group by conv_id, alone)
    select conv_id, n_turns::bigint as n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars,
      sha256(loss) as loss_sha256, chars::bigint as formatted_chars from c"""


def _secrets() -> str:
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    patterns = {0: rf"""({keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1: secret_scan.ACCESS, 2: secret_scan.HEX, 9: "[A-Za-z0-9+/_-]{16,}={0,2}"}
    matches = " union all ".join(f"select row, {k} as kind, regexp_extract_all(text, '{p}') as ms, string_split_regex(text, '{p}') as ps from t where regexp_matches(text, '{p}')" for k, p in patterns.items())
    kinds = ", ".join(f"({i}, '{e.alphabet}', '{''.join('01'[j >= len(e.alphabet) / 2] for j in range(len(e.alphabet)))}', {len(e.alphabet)}, {e.least}, {e.fold})" for i, e in enumerate(secret_scan.ENCODINGS))
    number = " ".join(f"when {' and '.join(f'regexp_matches(run, \'{x}\')' for x in (e.pattern, *e.has))} then {i}" for i, e in enumerate(secret_scan.ENCODINGS))
    names = ", ".join(f"'{k}'" for k in secret_scan.KINDS)

    def log_erfc(x: str) -> str:
        t, sum_ = f"(1 / (1 + {x} / 2))", str(secret_scan.ERFC[-1])
        for c in reversed(secret_scan.ERFC[:-1]):
            sum_ = f"({sum_} * {t} + {c})"
        return f"(ln({t}) - {x} * {x} + {sum_})"

    return f"""
        with t as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
        a as (select row, kind, unnest(ms) as m, unnest(ps[:len(ms)]) as p, unnest(range(len(ms))) as i from ({matches})),
        b as (select row, kind, m, (sum(length(p) + length(m)) over (partition by row, kind order by i))::bigint as till from a),
        base as (select row, kind, till - length(m) as start, till from b where kind < 9 and (kind > 0 or length(regexp_extract(m, '{patterns[0]}', 2)) >= {secret_scan.LEAST_VALUE})),
        runs as (select row, till - length(m) as start, till, regexp_replace(m, '=+$', '') as run from b where kind = 9),
        e as (select *, case {number} end as encoding from runs),
        k as (select * from (values {kinds}) as v(encoding, alphabet, bits, k, least, fold)),
        f as (select e.*, k.* exclude encoding, case when fold then lower(run) else run end as s, string_split(s, '') as cs, length(s)::double as n, 1.0::double / k as q
          from e join k using (encoding) where length(run) >= least),
        g as (select *, least({secret_scan.CLASSES - 1}, floor(log2(n)))::int as class,
          list_sum(list_transform(list_distinct(cs), lambda x: (length(s) - length(replace(s, x, '')))::double * (length(s) - length(replace(s, x, '')) - 1) / 2)) as pairs,
          abs(len(regexp_extract_all(translate(s, alphabet, bits), '0+|1+')) - 1 - (n - 1) / 2) - 0.5 as off,
          list_transform(cs, lambda c: strpos(alphabet, c) - 1 - (k - 1) / 2::double) as v, n * (n - 1) / 2 as couples from f),
        h as (select *, greatest(off, 0) / (sqrt(n - 1) / 2) / sqrt(2) as x2,
          abs(list_sum(list_transform(range(1, len(v)), lambda i: v[i] * v[i + 1])) / ((k * k - 1) / 12::double)) / sqrt(n - 1) / sqrt(2) as x3,
          couples * q * (1 - q) as variance, couples * q * (1 - q) * (1 - 2 * q) + n * (n - 1) * (n - 2) / 6 * 6 * q * q * (1 - q) as third,
          4 * variance ** 3 / (third * third) as shape, (pairs - 0.5 - couples * q) / sqrt(variance) as dev,
          sqrt(shape) * 3 * (cbrt(greatest(1 + dev / sqrt(shape), 0)) - 1 + 1 / (9 * shape)) / sqrt(2) as x1 from g),
        tested as (select row, start, till, encoding, class, greatest(0, least({secret_scan.MOST_STEP}, floor(-(least(
          case when x1 > 0 then {log_erfc('x1')} - ln(2) else 0 end, {log_erfc('x2')}, {log_erfc('x3')}) + ln(3)) / ln(10) * {secret_scan.STEPS})))::int as step from h),
        c as (select encoding, class, step, count(*) as n from tested group by all),
        d as (select *, sum(n) over (partition by encoding, class order by step desc) as beyond, sum(n) over (partition by encoding, class) as all_ from c),
        cut as (select encoding, class, min(step) as least_ from d where 10.0::double ** (-step / {secret_scan.STEPS}::double) * all_ <= {secret_scan.FALSE_DISCOVERIES} * beyond group by all),
        more as (select row, start, encoding + 3 as kind, till from tested left join cut using (encoding, class) where least_ is null or step < least_),
        every as (select row, start, kind, till from base union all select row, start, kind, till from more),
        named as (select *, [{names}][kind + 1] || ':' || start || ':' || till as named from every),
        o as (select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind > 2) as n_random,
          coalesce(string_agg(named, ',' order by start, kind, till) filter (kind < 3), '') as base, string_agg(named, ',' order by start, kind, till) as spans from named group by row)
        select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
          sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_random, 0)::bigint as n_random from t left join o using (row)"""


_SEARCH = rf"""
    with t as (select row_number() over () as row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
    own as (select row, doc_id, len(ws) as n from t where len(ws) > 0),
    corpus as (select count(*) as docs, sum(n)::bigint as terms from own),
    tf as (select row, w, count(*) as tf from (select row, unnest(ws) as w from t) group by all),
    df as (select w, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight from tf, corpus group by w, docs),
    q as (select row_number() over () as item, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
    q2 as (select item, item_id, w, count(*) as times from q group by all),
    s as (select item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
      from q2 join df using (w) join tf using (w) join own using (row), corpus group by all),
    r as (select *, row_number() over (partition by item order by score desc, doc_id) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from r where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _licenses(), "op2_embedding_near_dedup": _EMBEDDINGS, "op4_ngram_jaccard_join": _JACCARD, "op8_chat_format": _CHATS, "op11_secret_scan": _secrets(), "op12_lexical_search": _SEARCH}
