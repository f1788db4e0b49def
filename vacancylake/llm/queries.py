"""Registered queries of the corpus operators and their SQL counterparts."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylake.llm import cws, embedding_dedup, jaccard_join, language, line_dedup, merkle, mtree, packing, pieces, quality, secrets, spelling, url_filter
from vacancylake.llm.common import fold, table

#: Rules of the URL query (action, host, path) and the host labels whose pages make up its list: fixed values.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "cheap-pills", "free-bets", "adult-x")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.training_sample(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = line_dedup.dedup_lines(docs)
    return made.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text"), 256).alias("kept_sha256"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_path(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(url_filter.canonical(host, path).alias("key"))
    return url_filter.judge(pages, URL_RULES, listed)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cws.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    made = merkle.document_manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    folded = F.coalesce("version_root", merkle.fold(F.col("leaf"), F.col("path")))
    made = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_line_dedup, op4_top_k, op5_pieces, op6_packing, op7_secrets, op8_url_filter, op9_jaccard_join, op10_embedding_dedup, op11_fingerprints, op12_spelling, op13_merkle)}


def _crc32(listed: str) -> str:
    """SQL of the crc32 of a list of bytes, bit by bit."""
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: case when x & 1 = 1 then xor(3988292384, x >> 1) else x >> 1 end, xor(c, b))"
    return f"xor(4294967295, list_reduce({listed}, lambda c, b: {bits}, 4294967295))"


ORACLES = {
    "op3_line_dedup": r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)),
shared as (select key, min(doc_id) as first_doc from lines where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)),
marked as (select l.doc_id, l.pos, l.line, s.key is not null and l.doc_id <> s.first_doc as gone from lines l left join shared s on l.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op4_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as ints from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
pairs as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.ints, c.ints), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op8_url_filter": r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path from pages),
c as (select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') as canon from p),
rules(action, rhost, rpath) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (select h.host, h.path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(action, length(rhost || rpath)) as action
  from (select distinct host, path from c) h join rules on (h.host = rhost or ends_with(h.host, '.' || rhost)) and starts_with(h.path, rpath) group by h.host, h.path),
listed as (select distinct canon from c where list_has_any(string_split(host, '.'), ['ads-track', 'spam-farm', 'casino-win', 'cheap-pills', 'free-bets', 'adult-x']))
select page_id, c.host, c.path, f.rule, coalesce(f.action, case when l.canon is not null and c.host <> '' then 'block' else 'allow' end) as verdict
from c left join fits f on c.host = f.host and c.path = f.path left join listed l on l.canon = c.canon""",
    "op12_spelling": r"""
with recursive runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents)),
counted as (select doc_id, run, count(*) as k, """ + _crc32("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end))") + r""" as h
  from runs where length(run) >= 6 group by doc_id, run),
made as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from counted),
w as (select word, sum(k)::bigint as n from made where length(word) >= 6 group by word having sum(k) >= 5),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as pos from w),
cut as (select word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) as rest from gaps),
pairs as (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
  union select c.word, w.word, w.n from cut c join w on c.rest = w.word union select w.word, c.word, c.n from cut c join w on c.rest = w.word),
best as (select word, count(*) as n_near, arg_min(struct_pack(o := other, m := other_n), (-other_n, other)) as b from pairs group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 5 * w.n then b.o end as form, case when b.m >= 5 * w.n then b.m end as form_n from w left join best using (word)),
chain as (select word, coalesce(form, word) as at, form is null as done from forms
  union all select c.word, coalesce(f.form, f.word), f.form is null from chain c join forms f on f.word = c.at where not c.done)
select f.word, f.n, f.n_near, f.form, f.form_n, c.at as root from forms f join chain c on c.word = f.word and c.done""",
    "op13_merkle": r"""
with recursive fields as (select doc_id, lang, n_chars, """ + _crc32("list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint)") + r""" % 7 = 0 as hit,
  coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a, coalesce(strlen(text) || ':' || text, '-') as z from documents),
leaves as (select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf,
  case when hit then sha256(a || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || z) end as other,
  row_number() over (partition by lang order by doc_id) - 1 as i from fields),
tree as (select coalesce('=' || lang, '') as t, 0 as h, i, leaf as d, count(*) over (partition by lang) as m from leaves
  union all select * from (select t, h + 1, i // 2, sha256(string_agg(d, '' order by i)), (any_value(m) + 1) // 2 from tree where m > 1 group by t, h, i // 2)),
subroots as (select t, d, row_number() over (order by t) - 1 as i, count(*) over () as m from tree where m = 1),
top as (select 0 as h, i, d, m from subroots union all select * from (select h + 1, i // 2, sha256(string_agg(d, '' order by i)), (any_value(m) + 1) // 2 from top where m > 1 group by h, i // 2)),
walk as (select doc_id, leaf, coalesce(other, leaf) as node, '' as proof, coalesce('=' || lang, '') as t, 0 as h, i, false as over from leaves
  union all select * from (
    select w.doc_id, w.leaf, sha256(case when w.i % 2 = 1 then s.d || w.node else w.node || coalesce(s.d, '') end), w.proof || coalesce(s.d, ''), w.t, w.h + 1, w.i // 2, false
    from walk w join tree o on not w.over and o.t = w.t and o.h = w.h and o.i = w.i and o.m > 1 left join tree s on s.t = w.t and s.h = w.h and s.i = xor(w.i, 1)
    union all select w.doc_id, w.leaf, w.node, w.proof, w.t, 0, r.i, true from walk w join tree o on not w.over and o.t = w.t and o.h = w.h and o.i = w.i and o.m = 1 join subroots r on r.t = w.t
    union all select w.doc_id, w.leaf, sha256(case when w.i % 2 = 1 then s.d || w.node else w.node || coalesce(s.d, '') end), w.proof || coalesce(s.d, ''), w.t, w.h + 1, w.i // 2, true
    from walk w join top o on w.over and o.h = w.h and o.i = w.i and o.m > 1 left join top s on s.h = w.h and s.i = xor(w.i, 1)))
select w.doc_id, w.leaf, s.d as subroot, o.d as root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = o.d as verified
from walk w join top o on w.over and o.h = w.h and o.i = w.i and o.m = 1 join subroots s on s.t = w.t""",
}
