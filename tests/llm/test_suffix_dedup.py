import hashlib
import random
from collections import Counter

import pytest

from lumiframe.llm import suffix_dedup


def brute_places(texts, length):
    c = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    return [[i for i in range(len(b) - length + 1) if c[b[i : i + length]] > 1] for b in texts]


def brute(texts, length):
    out = []
    for b, places in zip(texts, brute_places(texts, length), strict=True):
        gone = {j for i in places for j in range(i, i + length)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        out.append((len(b), len(gone), spans, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    return out


def test_transform_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([3, 8, 20])
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            texts += [b"a" * 50, b"ab" * 30]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(texts, length)] == brute_places(texts, length)


def found(df):
    return sorted((r["doc_id"], r["n_bytes"], sum(x["stop"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect())


@pytest.mark.parametrize(("seed", "most", "block"), [(1, 1024, 1 << 18), (2, 2, 300)])
def test_texts(spark, seed, most, block):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 300))) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += ["".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80))), rng.choice(passages)]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "a" * 1000, "ab" * 400, "", passages[0] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(docs, length=50, most=most, block=block)
    assert found(out) == [(i, *b) for i, b in enumerate(brute([t.encode() for t in texts], 50))]


def test_edges_of_the_input(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    rows = [(None, None, 1), (1, "", 2), (2, "short", 3), (3, long, 4), (3, long, 4), (4, "x" * 250 + "é", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = suffix_dedup.remove_repeats(docs).collect()
    by = sorted((r["doc_id"] or 0, r["n_bytes"], len(r["removed"]), len(r["kept"])) for r in out)
    assert by == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 5, 0, 5), (3, 300, 1, 0), (3, 300, 1, 0), (4, 252, 1, 2)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_whole_characters(spark):
    docs = spark.createDataFrame([(1, "éa" * 30 + "z"), (2, "qa" * 2 + "éa" * 30)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs, length=11, whole_characters=True).collect():
        assert bytes(r["kept"]).decode() in ("z", "qa" * 2, "qaqa", "qaq", "")


def test_texts_beyond_a_piece(spark):
    """A text of more than a mebibyte, at production parameters: a long passage of it stands in another text, and at its own end."""
    rng = random.Random(12)
    part = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = part(900)
    long = part(700_000) + passage + part(500_000) + passage[:400]
    docs = spark.createDataFrame([(1, long), (2, "x" + passage[100:700] + "y"), (3, part(5000))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    at = 700_000
    assert [(x["start"], x["stop"]) for x in out[1]["removed"]] == [(at, at + 700), (at + 900 + 500_000, len(long))]
    assert [(x["start"], x["stop"]) for x in out[2]["removed"]] == [(1, 601)] and not out[3]["removed"]


def test_the_last_pass_at_default_parameters(spark):
    """More than MOST_SEGMENTS different texts around one passage, so that its hashes go from pass to pass."""
    rng = random.Random(13)
    part = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = part(230)
    n = suffix_dedup.MOST_SEGMENTS + 200
    texts = [part(40) + passage + part(40) for _ in range(n)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert found(out) == [(i, *b) for i, b in enumerate(brute([t.encode() for t in texts], suffix_dedup.LENGTH))]
