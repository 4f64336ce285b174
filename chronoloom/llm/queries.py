"""The operators of this folder over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.llm import (
    alignment as al, brown as br, exact_dedup as dd, jaccard as jc, langid as li, lexical as lx, mixing as mx,
    packing as pk, quality as ql, rabitq as rq, sharding as sh, simhash_trie as st, urls as ur)
from chronoloom.llm.text import ascii_lower, id_crc, word_count

QUERIES, ORACLES = {}, {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mx.mix_by_source(docs)


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dd.exact_dedup(docs, digest="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op2_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pk.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: The rules of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ur.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (id_crc(F.col("doc_id")) % 4) == 2
    judged = li.identify(docs.select("doc_id", "text", held.alias("held_out")), docs.filter(~held).select("text", "lang"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = (id_crc(F.col("doc_id")) % 5) == 0
    judged = ql.score(docs.select("doc_id", "text", held.alias("held_out")), docs.filter(~held), labels.filter(~held))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", ((id_crc(F.col("doc_id")) % 10) == 0).alias("held_out"))
    model, counts = br.train(docs.filter(~F.col("held_out")))
    return br.score(docs, model, counts, carry=("held_out",))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.search(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.near_copies(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.rendezvous(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jc.near_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op11_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(g) AS h, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 1) + 1),
                                         lambda i: array_to_string(words[i:i + 2], ' '))) AS g
    FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id,
         sum(times * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN n USING (doc_id) CROSS JOIN g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
