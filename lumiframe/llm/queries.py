"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm import bpe, langid, media, mixing, near_dup, sharding, suffix_dedup, token_count, topk, warc
from lumiframe.llm.common import shared_path

#: Shards of op8, neighbours of op7, and the percentage that op5's contract links at (100 x intersection >= percent x union).
SHARDS, TOP, LINK_PERCENT = 24, 10, 85


def tokenizer() -> str:
    """Path of the tokenizer file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    files = warc.write(warc.plan(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return warc.read(spark, folder, payloads=False, files=files).where("kind <> 'gap'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer()).drop("text")
    return bpe.decode(rows, tokenizer()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=LINK_PERCENT)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.sign_code().alias("code"))
    return topk.hamming_top_k(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), TOP)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS, ["lang", "source"], [])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, vocabulary = shared_path(spark, "tokens"), bpe.Vocabulary(tokenizer())
    eod = vocabulary.added["<|endoftext|>"]
    order = token_count.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer(), eod)
    return order.join(token_count.scan(spark, folder, eod, vocabulary.size, files=order), ["file", "ordinal"]).select("doc_id", "n_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_language_id, op2_mixing, op3_warc, op4_bpe, op5_minhash, op6_suffix_array, op7_hamming_topk, op8_hilbert_shards, op9_progressive_jpeg, op10_token_counts]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP2 = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CAST((i - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM p),
l AS (SELECT a.source, (SELECT sum(source_size)::DOUBLE FROM w) - coalesce(sum(b.cap), 0) AS rest, (SELECT sum(w) FROM w) - coalesce(sum(b.w), 0) AS w_rest
      FROM w a LEFT JOIN w b ON b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.i < a.i) GROUP BY a.source, a.i),
level AS (SELECT rest / w_rest AS level FROM l JOIN w ON l.source IS NOT DISTINCT FROM w.source WHERE rest / w_rest * w.w <= w.cap ORDER BY w.cap / w.w, w.i LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 0) * w) AS target FROM w),
r AS (SELECT d.*, t.source_size, t.target, least(3.0::DOUBLE, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END) AS rate,
      CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP5 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM w),
h AS (SELECT doc_id, md5(array_to_string(s, chr(1)) || len(s)) AS h FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a),
m AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP6 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS w FROM t, unnest(range(n - 199)) q(i) WHERE n >= 200),
g AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY w) > 1),
k AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS cut FROM g),
o AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM k),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS z FROM o GROUP BY 1, 2),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
r AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)
"""

OP7 = """
WITH c AS (SELECT vec_id, list_sum(list_transform(range(32), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN 1::BIGINT << i::BIGINT ELSE 0 END))::BIGINT AS lo,
                  list_sum(list_transform(range(32), lambda i: CASE WHEN coalesce(embedding[i + 33], 0) > 0 THEN 1::BIGINT << i::BIGINT ELSE 0 END))::BIGINT AS hi
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)) AS BIGINT) AS distance FROM c q, c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_mixing": OP2, "op3_warc": OP3, "op5_minhash": OP5, "op6_suffix_array": OP6, "op7_hamming_topk": OP7}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
