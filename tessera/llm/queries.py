"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bpe, exact_dedup, filter_audit, language_id, lm, packing, phrases, quality_rules, simhash, token_output, toxicity, url_filter, warc,
)
from tessera.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path(kind: str) -> str:
    """The public byte-level BPE; only the queries know where it is."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def _rules_sql() -> str:
    return ", ".join(f"('{r.host}', '{r.path}', '{'allow' if r.allow else 'block'}')" for r in url_filter.RULES)


def _block_sql() -> str:
    likes = [h.replace("_", "\\_").replace("*", "%") for h in url_filter.BLOCK_HOSTS]
    return " or ".join(f"host like '{x}' escape '\\'" for x in likes)


def _globs_sql() -> str:
    likes = [(h, h.replace("_", "\\_").replace("*", "%")) for h in url_filter.BLOCK_HOSTS]
    return " ".join(f"when host like '{x}' escape '\\' then '{h}'" for h, x in likes)


@query("op1_url_filter", f"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(h, p, v) as (values {_rules_sql()}),
best as (
  select s.page_id, s.host, s.path, max_by(r.h || r.p, length(r.h || r.p)) as rule,
    max_by(r.v, length(r.h || r.p)) as v
  from parts s left join rules r
    on (s.host = r.h or suffix(s.host, '.' || r.h)) and starts_with(s.path, r.p)
  group by all
)
select page_id, host, path, rule, coalesce(v, case when {_block_sql()} then 'block' else 'allow' end) as verdict,
  case when rule is null then case {_globs_sql()} end end as matched_host_glob
from best
""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op2_exact_dedup", """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op4_length_buckets")
def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are token counts of the public byte-level vocabulary."""
    count = token_output.token_counts(spark, vocabulary_path("tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), count(F.col("text")))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@query("op7_token_matrices")
def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per written matrix: its segments, their ends, and a digest of its ids."""
    written = token_output.write(table(spark, sf_dir, "documents"), work_path(spark, "token-matrices"), vocabulary_path("tiktoken"))
    return written.select(
        "matrix_id", "n_rows", "row_tokens", "n_tokens", F.col("segments.doc_id").alias("doc_ids"),
        F.col("segments.start").alias("starts"), F.col("segments.length").alias("lengths"),
        "cu_seqlens", "position_resets", F.sha2("ids", 256).alias("ids_sha256"),
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("json"))


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_BOUNDS = " and ".join(
    [f"{n} >= {lo}" for n, lo, _ in quality_rules.THRESHOLDS if lo is not None]
    + [f"{n} <= {hi}" for n, _, hi in quality_rules.THRESHOLDS if hi is not None]
)


@query("op10_quality_rules", f"""
with t as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents
), m as (
  select doc_id, w, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
    len(list_filter(w, lambda x: lower(x) in ({_STOP})))::bigint as n_stop_words
  from t
), v as (
  select doc_id, p, w[p:p + 7] as win from (select doc_id, w, unnest(range(1, n_words - 6)) as p from m)
), d as (select doc_id, win from v group by all having count(*) > 1),
c as (
  select doc_id, count(distinct q)::bigint as n_repeat_words
  from (select v.doc_id, unnest(range(v.p, v.p + 8)) as q from v join d on v.doc_id = d.doc_id and v.win = d.win)
  group by doc_id
), r as (
  select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    n_stop_words, n_lines,
    case when n_words = 0 then 0.0::double else word_chars / n_words::double end as mean_word_length,
    case when word_chars = 0 then 0.0::double else n_symbols / word_chars::double end as symbol_ratio,
    case when n_words = 0 then 0.0::double else n_stop_words / n_words::double end as stop_word_ratio,
    case when n_lines = 0 then 0.0::double else n_dup_lines / n_lines::double end as duplicate_line_ratio
  from m left join c on m.doc_id = c.doc_id
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {_BOUNDS} as kept
from r
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op11_warc", """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    max(page_id) over (partition by coalesce(html, '')) as last_id
  from pages
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < last_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < last_id then last_id end as refers_to
from p
""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written, then every record is read back from them."""
    pages = table(spark, sf_dir, "pages")
    found = warc.read(warc.write(pages, work_path(spark, "warc")), payloads=False).where("record_type != 'warcinfo'")
    as_id = lambda c: F.col(c).cast(pages.schema["page_id"].dataType)
    return found.select(
        as_id("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to_page").alias("refers_to")
    )


@query("op12_phrases", """
with w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w
  from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
  )
), t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4), (5)) as s(k)),
f as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a from g group by all having count(*) >= 100
), c as (
  select lang, k as words, phrase, string_split(phrase, ' ') as w, a from f where k > 1
), cuts as (
  select c.lang, c.phrase, c.a, i as cut, l.a as l, r.a as r, t.n,
    ((1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a))::bigint as score
  from (select *, unnest(range(1, words)) as i from c) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:i], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[i + 1:], ' ')
  join t on t.lang = c.lang
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inner_ as (
  select lang, array_to_string(w[i:j], ' ') as phrase, max(a) as longer
  from c, (values (1), (2), (3), (4)) as x(i), (values (2), (3), (4), (5)) as y(j)
  where i < j and j <= words and j - i + 1 < words group by all
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b left join inner_ o on o.lang = b.lang and o.phrase = b.phrase
where longer is null or 100 * longer < 100 * a
qualify rank <= 2000
""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@query("op13_filter_audit", """
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), l as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), f as (
  select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
      100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
      regexp_matches(text, '[#$%&*|]'), t.doc_id > first_id] as fails,
    coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from t left join l on t.doc_id = l.doc_id
), h as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all
), i(x) as (values (1), (2), (3), (4), (5)),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as o from i a, i b, i c, i d, i e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s as (select o, x as step, o[x] as own, o[1:x - 1] as before, o[1:x] as upto from orders, i),
r as (
  select part, o, step, own,
    coalesce(sum(n) filter (not list_bool_or([fails[y] for y in upto])), 0)::bigint as kept,
    coalesce(sum(n) filter (fails[own] and not coalesce(list_bool_or([fails[y] for y in before]), false)), 0)::bigint as removed,
    coalesce(sum(n) filter (fails[own] and coalesce(list_bool_or([fails[y] for y in before]), false)), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails[own] and not list_bool_or([fails[y] for y in list_filter([1, 2, 3, 4, 5], lambda z: z <> own)])), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails[own] and not coalesce(list_bool_or([fails[y] for y in before]), false)), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails[own] and not coalesce(list_bool_or([fails[y] for y in before]), false)), 0)::bigint as toxic_lost
  from h, s group by part, o, step, own
)
select part, array_to_string([substr('ABCDE', y, 1) for y in o], '') as filter_order, step,
  kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
