"""Registered queries: one per operator, over the whole of its table, with oracle SQL where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, exact_dedup, jaccard, licenses, line_dedup, line_frequency, mixing, packing, periodic, quality, topk, toxicity, url_rules

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest fitting rule of every page's url."""
    rules = url_rules.rule_table(spark, URL_RULES)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
with u as (
  select page_id, url, instr(url, '://') as pos from pages
), p as (
  select page_id,
         case when pos > 0 then translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*', 0),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from u
)
select page_id, host, path,
       case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
       case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'allow'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'block'
            when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'block'
            when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'block'
            else 'allow' end as verdict
from p
"""


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality statistics and the line-frequency verdict of every document."""
    return line_frequency.judge_documents(table(spark, sf_dir, "documents")).drop("left_share")


OP9_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as host, source is null as no_host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), placed as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d
), keyed as (
  select doc_id, i, concat(x, ' ', lead(x) over o, ' ', lead(x, 2) over o) as g, lead(x, 2) over o is not null as whole
  from placed window o as (partition by doc_id order by i)
), rep as (
  select doc_id, i, count(*) over (partition by doc_id, g) as n from keyed where whole
), covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep where n >= 2) group by doc_id
), lines as (
  select doc_id, host, no_host, norm, sum(len(norm) - len(replace(norm, ' ', '')) + 1) as n_words
  from (select doc_id, host, no_host, trim(regexp_replace(lower(unnest(ls)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from d)
  group by doc_id, host, no_host, norm
), spread as (
  select norm from lines group by norm having count(distinct doc_id) >= 100
), hot as (
  select host, no_host, norm from lines
  group by host, no_host, norm having count(*) >= 20 or norm in (select norm from spread)
), lost as (
  select l.doc_id, sum(case when hot.norm is null then n_words else 0 end)::double / sum(n_words) as left_share
  from lines l left join hot using (host, no_host, norm) group by l.doc_id
), s as (
  select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(left_share, 1) as left_share
  from d left join covered c using (doc_id) left join lost using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_share >= 0.75e0 as kept
from s
"""


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from (select distinct vec_id, embedding from embeddings)
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank, vec_id, score
from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
where rank <= 20
"""


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that a smaller doc_id holds taken out."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents
), k as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), o as (
  select *, min(doc_id) over (partition by key) as owner from k
), m as (
  select *, length(key) >= 10 and owner <> doc_id as gone from o
)
select doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.9 or more over 3-word shingles."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"), size=3, percent=90)


#: Share of the tokens that each domain gets.
MIX_TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the rows that ``labels`` covers: their language is the domain."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, rate and number of copies of every document under the target mix."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), MIX_TARGETS)
    return mixed.select(*[c for c in mixed.columns if c not in ("text_hash", "rows")],
                        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row")).drop("_row")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def planted_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document, made periodic from some word on if crc32 of its id ends in 0."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and the document without the repeats."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), planted_periods)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.o")).alias("length"),
        F.col("top.period").alias("period"), F.floor(F.expr("-top.o * 1000 div top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids after 5 rounds, and every vector's nearest."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", clusters.quantised(F.col("embedding")).alias("v"))
    return clusters.with_digest(*clusters.cluster(vectors, k=40, rounds=5, seed=2))


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round is one step of named tables: sums of squared differences, nearest, floor of means."""
    out = [f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select cast(row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as int) as cluster, v as c
  from v order by sha256('2:' || vec_id::varchar), v limit {k}
)"""]
    for r in range(rounds + 1):
        out.append(f""", a{r} as materialized (
  select vec_id, v, cluster, d from (
    select vec_id, v, cluster, d, row_number() over (partition by vec_id, v order by d, cluster) as place
    from (select vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
          from v cross join c{r})
  ) where place = 1
)""")
        if r < rounds:
            out.append(f""", m{r} as (
  select cluster, i, sum(x) as s, count(*) as n
  from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{r}) group by cluster, i
), c{r + 1} as materialized (
  select c.cluster, coalesce(n.c, c.c) as c
  from c{r} c left join (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from m{r} group by cluster) n using (cluster)
)""")
    return "".join(out) + f"""
select vec_id, cluster, d as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), hash_all=True)


OP13_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
       row_number() over w = 1 as kept, sha256(t) as text_sha256
from t window w as (partition by t order by n desc, doc_id)
"""


QUERIES = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_url_rules": op2_url_rules,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_license_scan": op5_license_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_gbdt": op8_quality_gbdt,
    "op9_line_frequency": op9_line_frequency,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bit_plane_clusters": op12_bit_plane_clusters,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL = {
    "op2_url_rules": OP2_SQL,
    "op7_exact_topk": OP7_SQL,
    "op9_line_frequency": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_bit_plane_clusters": _op12_sql(),
    "op13_exact_dedup": OP13_SQL,
}
