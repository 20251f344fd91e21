"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import Scratch, read_table
from .decontaminate import leaks
from .fingerprint import fingerprints
from .minhash import near_duplicates
from .mixing import mix_copies, source_targets
from .substring import repeated_passages
from .tokenfile import write_and_read
from .token_rollup import WORDS, Rollup, count_tokens, distinct_lines, revised, signed
from .url_filter import Rule, filter_urls
from .warc import bundle_and_read

#: The rules of op2, as its contract names them.
URL_RULES = [
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("block", "net/de/"),
    Rule("allow", "example.net/de/8"),
    Rule("block", "org/es/"),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_copies(docs, targets_of=lambda sums: [source_targets(sums[0])])
    return mixed.select("doc_id", "source", "size", F.col("cell_words").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scores = quality.score(docs, model)
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, revises those with repeated lines (each line stays once), deletes toxic ones, sends batches again.

    Batches move counts, not texts: a document's id finds its row in the ledger.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    scratch = Scratch(spark, "rollup")
    rollup = Rollup(spark, f"{scratch.root}/rollup")
    versions = [(WORDS, None), ("word_bpe_49k", tokenizer_path())]

    def counts(rows: DataFrame) -> DataFrame:
        out = [count_tokens(rows, version, path) for version, path in versions]
        return out[0].unionByName(out[1])

    ledger = scratch.table(counts(docs), "ledger")
    shorter = docs.filter("doc_id is not null").withColumn("once", distinct_lines(F.col("text"))).filter("once <> text")
    new = scratch.table(counts(shorter.select("doc_id", "source", "lang", F.col("once").alias("text"))), "revised")
    ids = new.select("doc_id").distinct()
    old = ledger.join(ids, "doc_id", "left_semi")
    gone = ledger.join(ids, "doc_id", "left_anti").unionByName(new).join(toxic, "doc_id", "left_semi")
    batches = [("load", signed(ledger, 1)), ("lines", revised(old, new)), ("toxic", signed(gone, -1))]
    for batch, changes in batches + batches[:2]:
        rollup.commit(batch, changes)  # the last two were there before: nothing happens
    rollup.compact()
    return rollup.totals()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_and_read(spark, read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, shingle=3, percent=85, with_rows=False)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_filter_urls": op2_filter_urls,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_files": op4_token_files,
        "op5_fingerprints": op5_fingerprints,
        "op6_quality": op6_quality,
        "op7_passages": op7_passages,
        "op8_token_rollup": op8_token_rollup,
        "op9_warc": op9_warc,
        "op10_minhash": op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_filter_urls": OP2_SQL, "op9_warc": OP9_SQL, "op10_minhash": OP10_SQL}


OP2_SQL = r"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(verdict, pattern, rule_host, rule_path) as (values
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'),
  ('block', 'org/es/', 'org', '/es/')),
fits as (
  select p.page_id, p.host, p.path, r.pattern, r.verdict,
    row_number() over (partition by p.page_id order by length(r.pattern) desc nulls last, r.pattern) as n
  from parts p left join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select page_id, host, path, pattern as rule, coalesce(verdict, 'allow') as verdict from fits where n = 1
"""

#: the digest is turned from hex to bits, and five bits at a time to base32
OP9_SQL = r"""
with h as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
b as (select page_id, body, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', hex[i])]), '') as bits from h),
f as (select page_id, octet_length(encode(body)) as size, min(page_id) over (partition by body) as first,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, 5 * i + 1, 5))::int, 1)), '') as digest from b)
select page_id, size::bigint as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""

#: all pairs that share a shingle, then all that is reachable
OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, len(s)::bigint as n from s),
u as materialized (select doc_id, hash(g) as g from (select doc_id, unnest(s) as g from s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as materialized (select a, b from e union all select b, a from e),
r(doc_id, c) as (select doc_id, doc_id from n union select t.b, r.c from r join both_ways t on r.doc_id = t.a),
m as (select doc_id, min(c) as c from r group by doc_id)
select doc_id, n as n_shingles, c as component_id, doc_id = c as kept from n join m using (doc_id)
"""
