from collections import Counter, defaultdict

from lumiframe.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water(sizes):
    """Shares by weight, what is above a limit reshared until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, open_ = float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in sorted(open_, key=str):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_ = open_ - {s}
    return target


def test_targets(spark):
    sizes = {"a": 100, "b": 3000, "c": 7, None: 500, "é": 0, "z": 40}
    out = {r["source"]: r for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()}
    want = water(sizes)
    assert all(abs(out[s]["target"] - want[s]) < 1e-6 for s in sizes)
    assert abs(sum(r["target"] for r in out.values()) - sum(sizes.values())) < 1e-6


def test_copies_and_mix(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}" if i % 50 else None) for i in range(4000)] + [(7, "w " * 8, "s3")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.copies(docs).collect()
    assert len(out) == len(rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["source_size"]
    want = water(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) < 0.1 * target[s]
    assert sorted(map(tuple, mixing.copies(docs).collect()), key=str) == sorted(map(tuple, out), key=str)
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    copies = Counter()
    for r in out:
        copies[r["doc_id"]] += r["copies"]
    assert mixed == +copies


def test_edges_of_the_input(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "b"), (None, "x y", "b"), (3, "w " * 50000, None), (4, " \t\n", "zero")]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], SCHEMA + ", size int, s_source string")
    out = {(r["doc_id"], r["source"]): r for r in mixing.copies(docs).collect()}
    assert out[(1, "a")]["size"] == 0 and out[(1, "a")]["target"] == 0 and out[(3, None)]["size"] == 50000
    assert mixing.mix(docs.toDF("doc_id", "text", "source", "size", "rate")).columns == ["doc_id", "text", "source", "size", "rate"]
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_ties_of_limits(spark):
    """Sources whose limits per weight are equal: whichever comes first, all are met together."""
    for sizes in ({"a": 100, "b": 200, "c": 300, "d": 10000}, {"a": 7, "b": 7, "c": 7, None: 7}, {"a": 0, "b": 0, "c": 50}, {"x": 1}):
        out = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()}
        want = water(sizes)
        assert all(abs(out[s] - want[s]) < 1e-6 for s in sizes), sizes
