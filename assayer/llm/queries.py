"""The queries of this subpackage, one for each operator, with SQL where SQL can say the same."""
from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, collocations, jaccard, labelled, merkle, ppm, repeats, revisits, rules, secret_scan, seeds, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), "doc_id", "text", shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                       with_bytes=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of every page: a full response, a later one for some, and two not-modified answers under variants of the URL."""
    page = F.col("page_id")
    base = F.timestamp_seconds(F.lit(1_704_067_200) + (page % 97) * 3600)
    pages = table(spark, sf_dir, "pages").select(
        page, "url", base.alias("base"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("bytes"))
    text = F.lit("text/html")

    def capture(n: int, url, hours: int, status: int, digest, headers) -> F.Column:
        return F.struct((page * 4 + n).alias("record_id"), url.alias("url"), (F.col("base") + F.expr(f"interval {hours} hours")).alias("captured"),
                        F.lit(status).alias("status"), headers.alias("headers"), digest.alias("payload_digest"))

    def headers(**fields) -> F.Column:
        return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v)]).cast("map<string,string>")

    tag, second = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"')), F.md5(F.concat("digest", F.lit("2")))
    tag2 = F.concat(F.lit('"'), F.substring(second, 1, 12), F.lit('"'))
    none = F.lit(None).cast("string")
    first = capture(0, F.col("url"), 0, 200, F.col("digest"),
                    F.when(page % 11 == 0, headers(content_type=text, content_length=F.col("bytes"), cache_control=F.lit("max-age=60"),
                                                   last_modified=F.lit("Mon, 01 Jan 2024 00:00:00 GMT")))
                    .otherwise(headers(content_type=text, content_length=F.col("bytes"), cache_control=F.lit("max-age=60"), etag=tag)))
    again = capture(1, F.concat("url", F.lit("#again")), 36, 200, second,
                    headers(content_type=text, content_length=F.lit("9"), etag=tag2))
    early = capture(2, F.regexp_replace("url", "^https?://", "HTTP://WWW."), 24, 304, none,
                    F.when(page % 5 == 0, headers(etag=F.lit('"other"'), x_cache=F.lit("HIT")))
                    .otherwise(headers(etag=F.concat(F.lit("W/"), tag), cache_control=F.lit("max-age=120"), content_length=F.lit("0"))))
    late = capture(3, F.concat("url", F.lit("#late")), 48, 304, none,
                   headers(last_modified=F.lit("Mon, 01 Jan 2024 00:00:00 GMT"), age=F.lit("7")))
    lone = F.when(page % 7 == 0, F.array(early)).when(page % 3 == 0, F.array(first, again, early, late)).otherwise(F.array(first, early, late))
    return pages.select(F.inline(lone))


_KEY = """regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end"""

OP10_SQL = f"""
with p as (select page_id, url, md5(coalesce(html, '')) d, strlen(coalesce(html, '')) n,
    make_timestamp((1704067200 + (page_id % 97) * 3600) * 1000000) base from pages),
r as (
  select page_id * 4 as record_id, url, base as captured, true as full_answer, d as digest, case when page_id % 11 <> 0 then '"' || d[1:12] || '"' end as etag,
    case when page_id % 11 = 0 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as modified, 'max-age=60' as cache, n as length, page_id
    from p where page_id % 7 <> 0
  union all select page_id * 4 + 1, url || '#again', base + interval 36 hour, true, md5(d || '2'), '"' || md5(d || '2')[1:12] || '"', null, null, 9, page_id
    from p where page_id % 7 <> 0 and page_id % 3 = 0
  union all select page_id * 4 + 2, regexp_replace(url, '^https?://', 'HTTP://WWW.'), base + interval 24 hour, false, null,
    case when page_id % 5 = 0 then '"other"' else 'W/"' || d[1:12] || '"' end, null, case when page_id % 5 = 0 then null else 'max-age=120' end, null, page_id from p
  union all select page_id * 4 + 3, url || '#late', base + interval 48 hour, false, null, null, 'Mon, 01 Jan 2024 00:00:00 GMT', null, null, page_id
    from p where page_id % 7 <> 0),
u as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from r),
v as (select *, list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
    lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref)=')) as q from u),
k as (select *, {_KEY} as url_key from v),
m as (select a.record_id, a.url_key, a.captured, a.etag, a.modified, a.cache, a.page_id,
    max_by(b, row(b.captured, b.record_id)) filter (b.record_id is not null) as f
  from k a left join (select * from k where full_answer) b on a.url_key = b.url_key and b.captured < a.captured
  where not a.full_answer group by all),
s as (select *, case when f is null then 'orphan'
    when f.etag is not null and etag is not null then case when f.etag = regexp_replace(etag, '^W/', '') then 'resolved' else 'changed' end
    when f.modified is not null and modified is not null then case when f.modified = modified then 'resolved' else 'changed' end
    else 'resolved' end as state from m)
select record_id, url_key, epoch(captured)::bigint as captured, state, f.record_id as response_id,
  epoch(f.captured)::bigint as response_captured,
  case when state = 'resolved' then f.digest end as payload_digest,
  case when state = 'resolved' then
    case when record_id % 4 = 3 then 'age: 7; ' else '' end
    || coalesce('cache-control: ' || coalesce(cache, f.cache) || '; ', '')
    || 'content-length: ' || f.length || '; content-type: text/html'
    || coalesce('; etag: ' || f.etag, '')
    || coalesce('; last-modified: ' || coalesce(modified, f.modified), '')
    || case when record_id % 4 = 2 and page_id % 5 = 0 then '; x-cache: HIT' else '' end end as headers
from s"""


@query("op10_revisits", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(spark, sf_dir))
    return found.withColumns({"headers": revisits.header_text(F.col("headers")), "captured": F.unix_seconds("captured"),
                              "response_captured": F.unix_seconds("response_captured")})


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), "doc_id", "text")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    fixed = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.span_text(fixed), 256).alias("base_sha256"),
                        secret_scan.span_text(F.col("spans")).alias("spans"))


@query("op1_merkle")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_test(table(spark, sf_dir, "documents"), "doc_id", "text")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> rules.RuleEnsemble:
    return rules.fit(labelled.sample(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality", 4, 2))


@query("op3_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model(spark, docs, sf_dir).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", (labelled.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled.sample(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic", 3, 1))
    return toxicity.score(docs, "doc_id", "text", model).select(
        "doc_id", (labelled.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.overlaps(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("op8_ppm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = labelled.fold(F.col("doc_id"), 7) != 2
    model = ppm.train(docs, "doc_id", "text", learn)
    scored = ppm.score(docs, "doc_id", "text", learn, model)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


OP4_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end) as s from d),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a as u, b as v from l union select b, a from l),
r as (select u as doc_id, u as reached from e union select r.doc_id, e.v from r join e on e.u = r.reached)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select doc_id, min(reached) as m from r group by doc_id) m using (doc_id)"""


@query("op4_jaccard", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), "doc_id", "text", words=4, num=85, den=100)


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


OP13_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from w, range(1, 5) as r(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as n from g group by all having count(*) >= 30),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1),
i as (select lang, a, w, unnest(range(2, k)) as m from c where k > 2),
s as (select lang, phrase, max(a) as a from (select lang, a, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from i) group by all),
x as (select c.*, unnest(range(1, k)) as j from c left join s using (lang, phrase) where s.a is null or 100 * s.a < 80 * c.a),
y as (select x.lang, x.phrase, x.a, x.j, l.n as l, r.n as r, ((2000000::hugeint * x.a) // (l.n + r.n))::bigint as score
  from x join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:j], ' ')
  join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[j + 1:], ' ')),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select o.lang, rank, phrase, a, l, r, t.n, score from o join t on t.lang = o.lang where rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), "text", "lang")


OP11_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
h as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as s from p),
r as (select doc_id, i from h qualify row_number() over (partition by s order by doc_id, i) > 1),
g as (select distinct doc_id, unnest(range(i, i + 20)) as i from r),
c as (select doc_id, list(i) as gone from g group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join c using (doc_id)"""


@query("op11_repeats", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents"), "doc_id", "text", window=20, stable=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
