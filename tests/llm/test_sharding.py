import zlib
from collections import Counter

from pyspark.sql import functions as F

from lumiframe.llm import queries, sharding


def test_the_curve_visits_every_cell_by_single_steps(spark):
    for dims, bits in ((2, 4), (3, 3)):
        n = 1 << bits
        cells = spark.range(n**dims).select(*[(F.floor(F.col("id") / n**i) % n).cast("int").alias(f"c{i}") for i in range(dims)])
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(n**dims))
        assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def laws(out, texts, shards):
    count = Counter(r["shard"] for r in out)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(out)
    for s in count:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(count[s]))
    by = {}
    for i, t in texts:
        b = (t or "").encode()
        by.setdefault(i, set()).add((len(b) + 8, zlib.crc32(b)))
    assert all((r["size"], r["text_crc32"]) in by[r["doc_id"]] for r in out)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = queries.op8_hilbert_shards(spark, sf).collect()
    laws(out, [tuple(r) for r in docs.collect()], 24)
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, queries.op8_hilbert_shards(spark, sf).collect()), key=str)


def test_edges_of_the_input(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (None, "é", "en", None), (5, "x" * 100000, "de", "s")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, size int")
    laws(sharding.shard(docs, 3, ["lang", "source"], []).collect(), [r[:2] for r in rows], 3)
    laws(sharding.shard(docs, 24, ["lang"], ["doc_id"]).collect(), [r[:2] for r in rows], 24)
    assert sharding.shard(docs.limit(0), 24, ["lang", "source"], []).count() == 0


def test_codes_of_many_values(spark):
    """More values than any list of them should hold: each has the code that its place among the rows gives."""
    n = 6000
    df = spark.range(n).select(F.format_string("v%05d", "id").alias("c"), F.when(F.col("id") < 10, F.lit(None)).otherwise(F.col("id") * 1.5).alias("x"))
    codes = {r["value"]: r["code"] for r in sharding.depth_codes(df, "c", 4).collect()}
    assert len(codes) == n and all(codes[f"v{i:05d}"] == 16 * i // n for i in range(n))
    numbers = {r["value"]: r["code"] for r in sharding.depth_codes(df, "x", 4).collect()}
    assert len(numbers) == n - 10 and all(numbers[i * 1.5] == 16 * (i - 10) // (n - 10) for i in range(10, n))
    hot = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10 + [(None,)] * 5, "c string")
    assert {r["value"]: r["code"] for r in sharding.depth_codes(hot, "c", 4).collect()} == {"a": 0, "b": 14}
    assert sharding.depth_codes(hot.limit(0), "c", 4).count() == 0


def test_equal_texts_are_neighbours(spark):
    rows = [(i, f"text {i % 40}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard(docs, 7, ["lang", "source"], []).collect()
    laws(out, [r[:2] for r in rows], 7)
    # texts of one size are in one cell, and a group of ten is cut only where the law cuts a run
    cuts = Counter()
    for crc in {r["text_crc32"] for r in out}:
        cuts[len({r["shard"] for r in out if r["text_crc32"] == crc})] += 1
    assert set(cuts) <= {1, 2} and cuts[2] <= 6


def test_written_shards_prune_on_several_dimensions(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and source is not null").withColumn("size", F.octet_length("text"))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 24, ["lang", "source"], [])
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    ends = []
    for f in sorted((tmp_path / "shards").rglob("*.parquet")):
        g = [pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
        cols = {g[0].column(i).path_in_schema: i for i in range(g[0].num_columns)}
        ends.append({c: (min(x.column(cols[c]).statistics.min for x in g), max(x.column(cols[c]).statistics.max for x in g)) for c in ("lang", "source", "size")})
    lang = docs.groupBy("lang").count().orderBy(F.desc("count")).first()["lang"]
    big = docs.approxQuantile("size", [0.8], 0)[0]
    read = lambda keep: sum(map(keep, ends))
    assert len(ends) == 24 and read(lambda e: e["lang"][0] <= lang <= e["lang"][1]) < 20 and read(lambda e: e["size"][1] >= big) < 20
    assert read(lambda e: e["lang"][0] <= lang <= e["lang"][1] and e["size"][1] >= big) < 12
