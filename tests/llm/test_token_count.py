import random

import numpy as np
import pytest

from lumiframe.llm import bpe, queries, token_count
from lumiframe.llm.common import shared_path
from lumiframe.llm.files import Output, open_store


def put(folder, name, ids, kind="<u2"):
    out = Output(folder, name)
    out.write(np.array(ids, dtype=kind).tobytes())
    out.close()


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_blocks_are_stitched(spark, block):
    rng = random.Random(block)
    folder, want = shared_path(spark, "tokens"), []
    for f in range(5):
        ids, lengths = [], [rng.choice([0, 0, 1, 3, 40]) for _ in range(rng.randint(0, 30))]
        for i, n in enumerate(lengths):
            ids += [rng.randrange(9) for _ in range(n)] + [9]
            want.append((f"f{f}.tok", i, n, True))
        if f % 2:
            ids += [1] * f
            want.append((f"f{f}.tok", len(lengths), f, False))
        put(folder, f"f{f}.tok", ids)
    got = token_count.scan(spark, folder, 9, 10, block)
    assert sorted(map(tuple, got.select("file", "ordinal", "n_tokens", "terminated").collect())) == sorted(want)


def test_query_counts_tokens(spark, sf):
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "<|endoftext|> in a text"), (5, "long " * 40000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, file string")
    folder, v = shared_path(spark, "tokens"), bpe.Vocabulary(queries.tokenizer())
    order = token_count.write_token_files(docs, folder, queries.tokenizer(), 50256, file_bytes=1000)
    put(folder, "part-00000-lost-0000.tok", [1, 2, 50256])  # of an attempt that wasn't committed
    out = order.join(token_count.scan(spark, folder, 50256, v.size, 64, order), ["file", "ordinal"]).collect()
    encoder = bpe.Encoder(v, special=False)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(i), len(encoder([t or ""])[0])) for i, t in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: len(encoder([r["text"] or ""])[0]) for r in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op10_token_counts(spark, sf).collect()} == want


def test_empty_folder(spark):
    folder = shared_path(spark, "tokens")
    assert token_count.scan(spark, folder, 9, 10).count() == 0
    put(folder, "a.tok", [])
    assert token_count.scan(spark, folder, 9, 10).count() == 0
    store, path = open_store(folder)
    with store.open_output_stream(f"{path}/b.tok") as f:
        f.write(b"\x01\x00\x09\x00\x07")  # half an identifier at the end
    assert [tuple(r) for r in token_count.scan(spark, folder, 9, 10).select("ordinal", "n_tokens").collect()] == [(0, 1)]


def test_wide_identifiers(spark):
    folder = shared_path(spark, "tokens")
    put(folder, "a.tok", [70000, 9, 70000, 70000, 9], "<u4")
    assert sorted(r["n_tokens"] for r in token_count.scan(spark, folder, 9, 100000).collect()) == [1, 2]
