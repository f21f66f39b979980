"""The queries of this package over whole tables: against their SQL, or against what other libraries say."""

import hashlib
import zlib

import duckdb
import pytest

from lumiframe.llm import media, queries


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if n != "pipeline"))
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(want.columns, r, strict=True))) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == theirs


def test_op4_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    got = {r["doc_id"]: r for r in queries.op4_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_keeps_every_byte(spark, sf):
    """Digests from the texts themselves; stored media from the writer, features from the decoded tensors."""
    got = {r["doc_id"]: r for r in queries.op9_progressive_jpeg(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        own = tuple(g[c] for c in ("media_bytes", "media_sha256", "feature"))
        assert by_text.setdefault(data, own) == own
    for r in rows[:20]:
        jpeg = media.write_jpeg(media.pad((r["text"] or "").encode()))
        assert (got[r["doc_id"]]["media_bytes"], got[r["doc_id"]]["media_sha256"]) == (len(jpeg), hashlib.sha256(jpeg).hexdigest())
