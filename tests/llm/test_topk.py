import numpy as np
import pytest

from lumiframe.llm import topk


def brute(codes, queries, k):
    out = []
    for q, qc in queries:
        ranked = sorted(((bin((qc ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes))[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(ranked)]
    return sorted(out)


def signed(x):
    return int(np.uint64(x).astype(np.int64))


@pytest.mark.parametrize(("seed", "segments"), [(1, None), (2, 4), (3, 7)])
def test_against_brute_force(spark, seed, segments):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = [(i, signed(base[i % 12] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False))))) for i in range(300)]
    codes += [(1000 + i, signed(base[0])) for i in range(40)]  # a common code
    asked = codes[::17]
    df = spark.createDataFrame(codes, "vec_id long, code long")
    q = spark.createDataFrame(asked, "query_id long, code long")
    out = topk.hamming_top_k(df, q, 10, segments)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in out.collect()) == brute(codes, asked, 10)


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, 7), (3, 5), (3, 5), (4, -1)], "vec_id long, code long").selectExpr("*", "7 as q_code", "'x' as seg", "1 as n", "2 as distance")
    q = spark.createDataFrame([(1, 5), (9, None), (None, 5)], "query_id long, code long").selectExpr("*", "3 as vec_id", "1 as rank")
    out = topk.hamming_top_k(df, q, 10)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in out.collect()) == [(1, 1, 1, 0), (1, 2, 3, 0), (1, 3, 3, 0), (1, 4, 4, 62)]
    assert topk.hamming_top_k(df.limit(0), q, 10).count() == 0
    assert topk.hamming_top_k(df, q.limit(0), 10).count() == 0


def test_sign_codes(spark):
    v = [1.0, -1.0, 0.0, 2.0] + [0.0] * 59 + [3.0]
    rows = [(1, v), (2, None), (3, []), (4, [None, 1.0])]
    out = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.sign_code().alias("c"))
    assert [r["c"] for r in out.orderBy("vec_id").collect()] == [signed((1 << 63) | 9), None, 0, 2]


def test_work_grows_with_the_queries_not_with_all_pairs(spark, monkeypatch):
    """Codes that a query verifies: a few buckets of the index, far from all codes, whose number grows sixteenfold."""
    met = {}
    plain = topk.materialize

    def counted(df, name):
        out = plain(df, name)
        if name == "best":
            met[n] = met.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(topk, "materialize", counted)
    rng = np.random.default_rng(5)
    for n in (500, 8000):
        base = rng.integers(0, 2**63, n // 20, dtype=np.uint64)
        codes = [(i, signed(base[i % len(base)] ^ np.uint64(1 << int(rng.integers(0, 64))))) for i in range(n)]
        df = spark.createDataFrame(codes, "vec_id long, code long")
        topk.hamming_top_k(df, spark.createDataFrame(codes[:10], "query_id long, code long"), 5).collect()
    assert met[8000] <= 2 * met[500] + 50
