"""The queries opN_<name>: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesio.llm import ngram_join, packing, pii, quality, secrets, sentence_pieces, shared, token_counts, token_files, va_search, warc


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.Tables(spark, "secrets"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are UTF-8 bytes and an end mark, clusters the classes of the n-gram Jaccard join."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shared.Tables(spark, "packing")
    joined = ngram_join.join(docs, store)
    classes = store(joined.where("n_links > 0 or n_copies > 1").select("doc_id", "hash", "class_id", "class_hash").distinct(), "classes")
    lengths = docs.select("doc_id", F.xxhash64("text").alias("hash"), (F.octet_length("text") + 1).alias("bytes"), "source")
    same = classes.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    rows = lengths.join(same, lengths["doc_id"].eqNullSafe(same["_id"]) & (lengths["hash"] == same["_hash"]), "left")
    cluster = F.when(F.col("class_hash").isNotNull(), F.xxhash64("class_id", "class_hash")).otherwise(F.col("hash"))
    return packing.packed(store(rows.select(lengths["doc_id"], "source", "bytes", cluster.alias("cluster")), "rows"), F.col("bytes"), F.col("cluster"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text that they decode to, by the BPE model and by the unigram model of its pieces."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for model, unigram in (("bpe", False), ("unigram", True)):
        encoded = sentence_pieces.encode(docs, shared.Tables(spark, f"pieces-{model}"), unigram=unigram)
        back = sentence_pieces.decode(encoded, unigram=unigram)
        one = back.select("doc_id", F.lit(model).alias("model"), "n_chunks", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("text_sha256"))
        found = one if found is None else found.unionByName(one)
    return found


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = warc.read(warc.write(pages, shared.work_dir(spark, "warc")))
    return archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, shared.Tables(spark, "va-search"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files.read(token_files.write(docs, shared.work_dir(spark, "token-ids")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.Tables(spark, "ngram-join"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pii.replaced(docs.select("doc_id", "text"), shared.Tables(spark, "pii"), shared.secret_key(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = shared.saved(quality.measure(docs, ["doc_id"]), shared.work_dir(spark, "measures"))
    return quality.judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_warc": op5_warc,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_token_ids": op7_token_ids,
    "op8_ngram_join": op8_ngram_join,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
}



def _secrets_sql() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = quoted(f"(?:{names})" + secrets.ASSIGN.partition(")")[2])
    patterns = [assign, *map(quoted, (secrets.ACCESS, secrets.HEX, secrets.RUN))]
    found = " union all ".join(f"select r, {k} kind, regexp_extract_all(x, {p}) m, string_split_regex(x, {p}) b from t" for k, p in enumerate(patterns))
    fits = lambda alphabet, needs: " and ".join([f"translate(s, '{alphabet}', '') = ''", *(f"regexp_matches(s, '{n}')" for n in needs)])
    alphabet = "case " + " ".join(f"when {fits(letters, needs)} then '{letters}'" for _, letters, needs in secrets.ENCODINGS) + " end"
    kind = " ".join(f"when n >= {least} then {k}" for k, least in reversed(list(enumerate(secrets.CLASSES))))
    tail = lambda z: f"greatest(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * (1 / (1 + 0.2316419 * ({z}))) * (0.319381530 + 1 / (1 + 0.2316419 * ({z})) * (-0.356563782 + 1 / (1 + 0.2316419 * ({z})) * (1.781477937 + 1 / (1 + 0.2316419 * ({z})) * (-1.821255978 + 1 / (1 + 0.2316419 * ({z})) * 1.330274429)))), 1e-7)"
    return f"""
with t as (select row_number() over () r, doc_id, coalesce(text, '') x from documents),
f as ({found}),
i as (select r, kind, m, b, unnest(range(1, len(m) + 1)) i from f),
a as (select r, kind, m[i] s, (list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::int start from i),
base as (select r, kind, start, start + length(s) stop from a where kind < 3 and (kind > 0 or length(regexp_extract(s, {assign}, 1)) >= 6)),
e as (select r, start, s, length(s) n, {alphabet} letters from a where kind = 3),
v as (select r, start, n, length(letters) a, list_transform(string_split(s, ''), lambda c: strpos(letters, c) - 1) x from e where letters is not null),
q as (select *, a * list_sum(list_transform(range(a), lambda k: power(len(list_filter(x, lambda y: y = k)), 2))) / n - n chi,
    len(list_filter(x, lambda y: 2 * y >= a)) high, 1 + len(list_filter(range(1, n), lambda j: (2 * x[j] >= a) <> (2 * x[j + 1] >= a))) runs,
    abs(list_sum(list_transform(range(1, n), lambda j: (x[j] - (a - 1) / 2) * (x[j + 1] - (a - 1) / 2)))) products from v),
z as (select *, (power(chi / (a - 1), 1 / 3) - (1 - 2 / (9 * (a - 1)))) / sqrt(2 / (9 * (a - 1))) zc, 2 * high * (n - high) / n + 1 mu,
    products / ((a * a - 1) / 12 * sqrt(n - 1)) zs from q),
y as (select *, case when high = 0 or high = n then 99 else abs(runs - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)) end zr from z),
p as (select *, -(ln(case when zc >= 0 then {tail('zc')} else 1 - {tail('-zc')} end) + ln(least(2 * {tail('zr')}, 1)) + ln(least(2 * {tail('zs')}, 1))) h from y),
c as (select r, start, start + n stop, case {kind} end class, least(floor(-10 * log10(exp(-h) * (1 + h + h * h / 2))), 60)::int level from p),
g as (select class, level, count(*) k from c group by all),
u as (select class, level, sum(k) over (partition by class order by level desc) reached, sum(k) over (partition by class) total from g),
d as (select class, min(level) least_level from u where pow(10, -level / 10) <= 0.05 * reached / total group by class),
tops as (select class, unnest(range(1, 62)) top from (select distinct class from g)),
told as (select class, top, sum(k) filter (level < top) reported, (1 + coalesce(sum(k) filter (level < 3), 0)) / (1 - pow(10, -0.3)) keys
  from tops join g using (class) group by all),
below as (select class, max(top) top from told left join d using (class)
  where top <= coalesce(least_level, 61) and reported - least(reported, keys * (1 - pow(10, -top / 10))) <= 0.5 * reported group by class),
random as (select c.r, 3 kind, start, stop from c join below using (class) where level < top
  and not exists (select 1 from base where base.r = c.r and base.start <= c.start and base.stop >= c.stop)),
w as (select *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop s from (select * from base union all select * from random)),
o as (select r, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex, count(*) filter (kind = 3) n_random,
    string_agg(s, ',' order by start, kind, stop) filter (kind < 3) base, string_agg(s, ',' order by start, kind, stop) spans from w group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_random, 0) n_random
from t left join o using (r)
"""


ORACLES: dict[str, str] = {
    "op1_secrets": _secrets_sql(),
    "op5_warc": """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html)) payload_bytes, sha256(encode(html)) payload_digest from p),
f as (select payload_digest, min(page_id) first from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and (page_id > first or page_id is null and first is not null) then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and (page_id > first or page_id is null) then first end refers_to
from d left join f using (payload_digest)
""",
    "op6_exact_top_k": """
with v as (select row_number() over () r, vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)) x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.x, c.x)::bigint score
  from v q, v c where q.vec_id % 20 = 0 and q.r <> c.r and len(q.x) = len(c.x))
select query_id, row_number() over (partition by r order by score desc, vec_id nulls last)::int "rank", vec_id, score
from s qualify "rank" <= 20
""",
    "op8_ngram_join": r"""
with recursive t as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words
  from documents),
g as (select r, doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) i from t where len(words) > 0),
s as (select distinct r, doc_id, array_to_string(words[i:i + 4], ' ') g from g),
k as (select r, doc_id, md5(string_agg(g, chr(10) order by g)) node, count(*) n from s group by all),
nodes as (select node, coalesce(min(doc_id), 9223372036854775807) doc_id, min(n) n, count(*) copies, min(r) r from k group by node),
q as (select node, n, g from nodes join s using (r)),
e as (select x.node a, y.node b from q x join q y on x.g = y.g and x.node < y.node
  group by x.node, y.node having 5 * count(*) >= 4 * (min(x.n) + min(y.n) - count(*))),
l as (select a, b from e union all select b, a from e),
c(node, root) as (select node, doc_id from nodes union select l.b, c.root from c join l on l.a = c.node),
m as (select node, nullif(min(root), 9223372036854775807) class_id from c group by node),
d as (select a node, count(*) n_links from l group by a)
select t.doc_id, case when k.node is null then t.doc_id else class_id end class_id, coalesce(n_links, 0) n_links, coalesce(copies, 1) n_copies
from t left join k using (r) left join m using (node) left join d using (node) left join nodes using (node)
""",
    "op10_quality_rules": r"""
with t as (select row_number() over () r, doc_id, coalesce(source, '') source, coalesce(text, '') text,
  regexp_extract(coalesce(source, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)', 1) named,
  case when named <> '' then lower(named) else coalesce(source, '') end host from documents),
w as (select r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from t),
g as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] g
  from (select r, words, unnest(range(1, len(words) - 1)) i from w)),
p as (select r, i from (select r, i, count(*) over (partition by r, g) n from g) where n > 1),
c as (select r, count(distinct j) n_repeat_words from (select r, unnest([i, i + 1, i + 2]) j from p) group by r),
m as (select doc_id, host, len(words) n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, len(lines) n_lines,
    len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words
  from w left join c using (r)),
f as (select *, (n_words < 50)::int a, (100 * n_repeat_words > 50 * n_words)::int b, (10 * n_symbols > n_words)::int c,
    (10 * n_dup_lines > 3 * n_lines)::int d, (word_chars < 2 * n_words or word_chars > 15 * n_words)::int e from m),
h as (select host, rule, count(*) n, sum(x) k from (
  select host, unnest(['a', 'b', 'c', 'd', 'e']) rule, unnest([a, b, c, d, e]) x from f) group by 1, 2),
s as (select rule, sum(k) / sum(n) p, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) room,
    case when p > 0 and p < 1 and room > 1e-9 * sum(n) then ((sum(k * k / n) - p * sum(k)) / (p * (1 - p)) - (count(*) - 1)) / room else 0 end between_
  from h group by 1),
v as (select host, max(case when between_ <= 1e-9 then p else (k + p * (1 / least(between_, 1) - 1)) / (n + 1 / least(between_, 1) - 1) end) > 0.5 bad
  from h join s using (rule) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (a = 1 or b = 1) base_failed,
  not (a = 1 or b = 1) and not (bad and greatest(a, b, c, d, e) = 1) kept
from f join v using (host)
""",
}
