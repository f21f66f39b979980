import hashlib
import zlib
from base64 import b32encode

from lumiframe.llm import warc
from lumiframe.llm.common import shared_path
from lumiframe.llm.files import Output


def salvaged(data):
    return [(r["kind"], r["offset"], r["length"], r.get("record_id")) for r in warc.Salvage(lambda n, o: data[o : o + n], len(data))]


def test_salvage():
    recs = [warc.record(f"urn:page:{i}", f"http://x/{i}", b"payload %d " % i * 50, None if i % 3 else "urn:page:1") for i in range(6)]
    starts = [sum(map(len, recs[:i])) for i in range(7)]
    data = b"".join(recs)
    whole = [("revisit" if i % 3 == 0 else "response", starts[i], len(recs[i]), f"urn:page:{i}") for i in range(6)]
    assert salvaged(data) == whole
    for k in range(6):
        for at in range(starts[k], starts[k + 1], 7):
            bad = bytearray(data)
            bad[at] ^= 0x5A
            got = salvaged(bytes(bad))
            lost = [r for r in whole if r not in got]
            assert lost in ([], [whole[k]]), (k, at, got)
            gaps = [g for g in got if g[0] == "gap"]
            assert (not lost and not gaps) or gaps == [("gap", starts[k], len(recs[k]), None)]
    assert salvaged(b"junk" + data + b"tail") == [("gap", 0, 4, None), *[(k, o + 4, n, i) for k, o, n, i in whole], ("gap", len(data) + 4, 4, None)]
    assert salvaged(data[:-9])[-1] == ("gap", starts[5], len(recs[5]) - 9, None)
    assert salvaged(b"") == []


def test_salvage_of_plain_records():
    recs = [zlib.decompress(warc.record(f"urn:page:{i}", "http://x/", b"some text %d" % i * 30, None), 31) for i in range(4)]
    data = b"".join(recs)
    assert [r[0] for r in salvaged(data)] == ["response"] * 4
    at = data.index(b"Content-Length: ", len(recs[0])) + 16
    bad = data[:at] + b"9" + data[at + 1 :]
    assert [(r[0], r[3]) for r in salvaged(bad)] == [("response", "urn:page:0"), ("gap", None), ("response", "urn:page:2"), ("response", "urn:page:3")]
    assert [r[0] for r in salvaged(data[: len(recs[0])] + b"\0" * 5000 + data[len(recs[0]) :])] == ["response", "gap", "response", "response", "response"]


def test_round_trip(spark):
    rows = [(3, "http://a\nb", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (9, "u", "é" * 300000), (None, "u", "<p>same</p>"), (7, "u", "once"), (7, "u", "once"), (8, "u", "once")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder = shared_path(spark, "warc")
    files = warc.write(warc.plan(pages), folder, 20000)
    assert files.agg({"records": "sum"}).first()[0] == len(rows)
    lost = Output(folder, "part-00000-lost-0000.warc.gz")  # of an attempt that wasn't committed
    lost.write(warc.record("urn:page:3", "u", b"<p>same</p>", None))
    lost.close()
    assert warc.read(spark, folder).count() == len(rows) + 1
    got = warc.read(spark, folder, files=files).collect()
    assert sorted(r["kind"] for r in got if r["kind"] != "gap") == sorted(["revisit"] * 3 + ["response"] * 6)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in got:
        page = int(r["record_id"][9:]) if r["record_id"][9:] else None
        html = next(h or "" for i, _, h in rows if i == page)
        b = html.encode()
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == b32encode(hashlib.sha1(b).digest()).decode()
        if r["kind"] == "revisit":
            assert r["refers_to"] == f"urn:page:{first[html]}" and page != first[html]
        else:
            assert bytes(r["payload"]) == b
    assert warc.plan(pages, least=5).where("refers_to is not null").count() == 1
    empty = shared_path(spark, "warc")
    warc.write(warc.plan(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_salvage_of_a_member_with_many_records():
    recs = [zlib.decompress(warc.record(f"urn:page:{i}", "http://x/", b"some text %d" % i * 30, None), 31) for i in range(5)]
    pack = lambda parts: (c := zlib.compressobj(5, zlib.DEFLATED, 31)).compress(b"".join(parts)) + c.flush()
    one = pack(recs)
    assert salvaged(one) == [("response", 0, len(one), f"urn:page:{i}") for i in range(5)]
    names = lambda data: [(k, i) for k, _, _, i in salvaged(data)]
    bad = recs[2].replace(b"some text", b"same text", 1)
    sound = [("response", f"urn:page:{i}") for i in range(5)]
    for k in range(5):
        want = [*sound[:k], ("gap", None), *sound[k + 1 :]]
        assert names(pack([*recs[:k], recs[k].replace(b"some text", b"same text", 1), *recs[k + 1 :]])) == want
    assert names(pack([bad])) == [("gap", None)] and names(pack([b"junk"])) == [("gap", None)]
    # other members around it, and one that is cut
    alone = warc.record("urn:page:9", "http://x/", b"alone", None)
    assert names(alone + one + alone) == [("response", "urn:page:9"), *sound, ("response", "urn:page:9")]
    assert names(one[:-9] + alone) == [("gap", None), ("response", "urn:page:9")]


def test_headers_of_any_length():
    plain = zlib.decompress(warc.record("urn:page:1", "http://x/", b"some text", None), 31)
    wide = plain.replace(b"WARC-Date", b"X-Long: " + b"a" * (17 << 20) + b"\r\nWARC-Date", 1)
    assert [(r[0], r[3]) for r in salvaged(wide + plain)] == [("response", "urn:page:1")] * 2
    pack = lambda x: (c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(x) + c.flush()
    assert [(r[0], r[3]) for r in salvaged(pack(wide) + pack(plain))] == [("response", "urn:page:1")] * 2
    # a version line whose header has no end of its own costs itself alone
    assert [r[0] for r in salvaged(b"WARC/1.1\r\nX y\r\n" + plain)] == ["gap", "response"]
