"""Removal of long repeated byte strings with a Burrows-Wheeler transform and threshold-bounded interval expansion.

Every window of LENGTH bytes is filed under the least hash of its byte grams, so that equal windows meet, and runs of
neighbouring windows with the same least hash are one segment. Segments of a hash that occurs once hold nothing
repeated. For the others, a task builds the transform of the segments that it is dealt and extends all intervals of
equal prefixes backwards, one byte at a time: round l finds the boundaries between suffixes that share exactly l bytes.
The rounds stop at LENGTH; suffixes that no boundary has parted by then start with repeated windows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import bounded_batches, discard, materialize, text_bytes, with_columns_from

#: Bytes of a repeated string; bytes of the grams of each pass, the last one the whole window; different segments of one hash that a
#: pass takes (those with more go to the next pass, whose last one has one segment a hash); windows of a segment; bytes of one transform.
LENGTH, GRAMS, MOST_SEGMENTS, MOST_WINDOWS, BLOCK = 200, (0.32, 0.8, 1.0), 1024, 256, 1 << 16

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _C
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the bytes [i, i + gram) for each i: of runs of 1, 2, 4 ... bytes, joined by the binary digits of gram."""
    run, power, size = data.astype(np.uint64) + np.uint64(1), int(_A), 1
    out, have, out_power = None, 0, 1
    left = gram
    while left:
        if left & 1:
            if out is None:
                out, have = run.copy(), size
            else:
                n = len(data) - have - size + 1
                out, have = out[:n] * np.uint64(power) + run[have : have + n], have + size
        left >>= 1
        if left:
            n = len(run) - size
            run = run[:n] * np.uint64(power) + run[size : size + n]
            power, size = power * power & (1 << 64) - 1, size * 2
    return _mixed(out)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for each i."""
    size, out = 1, h
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out


def segments(data: bytes, starts: np.ndarray, stops: np.ndarray, gram: int, length: int = LENGTH, hash_only: bool = False):
    """hash, content, start, windows of the segments of the windows that start in [starts, stops) of data.

    The ranges must leave room for the windows. content is a hash of the segment's grams in order. hash_only: the hash
    alone, and once more where the least gram stands at several places of its segment, without which the segment's own
    windows all differ.
    """
    width = length - gram + 1
    ones = [np.array([], np.uint64)] * 2 + [np.array([], np.int64)] * 2
    parts = []
    for a, b in zip(starts, stops, strict=True):
        for s in range(a, b, _PIECE):
            e = min(b, s + _PIECE)
            parts.append((s, e))
    got = []
    for s, e in parts:
        x = np.frombuffer(data, np.uint8, e - s + length - 1, s)
        h = gram_hashes(x, gram)
        least = window_minima(h, width)
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [e - s]])
        # cut very long runs, as in periodic texts
        long = last - first > MOST_WINDOWS
        if long.any():
            cuts = [np.arange(f, l, MOST_WINDOWS) for f, l in zip(first[long], last[long], strict=True)]
            first = np.sort(np.concatenate([first[~long], *cuts]))
            last = np.concatenate([first[1:], [e - s]])
        if hash_only:
            reach = last - first + width - 1
            ends = np.cumsum(reach)
            same = h[np.repeat(first - ends + reach, reach) + np.arange(ends[-1])] == np.repeat(least[first], reach)
            inner = np.add.reduceat(same, ends - reach, dtype=np.int32) > 1
            got.append((np.concatenate([least[first], least[first][inner]]),))
            continue
        # content: a polynomial of the mixed gram hashes, shifted to start at power 0
        powers, inverse = _powers(len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
        content = _mixed((sums[last + width - 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _B)
        got.append((least[first], content, first + s, last - first))
    if hash_only:
        return np.concatenate([x for (x,) in got]) if got else ones[0]
    return [np.concatenate(x) if got else o for x, o in zip(zip(*got) if got else [()] * 4, ones, strict=True)]


@functools.lru_cache(2)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _A, np.uint64)), np.cumprod(np.full(n, np.uint64(pow(int(_A), -1, 1 << 64)), np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the content hash's base and of its inverse."""
    a, b = _all_powers(max(_PIECE, 1 << (n - 1).bit_length()))
    return a[:n], b[:n]


def _cut_by(fresh: np.ndarray, boundary: np.ndarray, before: np.ndarray, back: np.ndarray) -> np.ndarray | None:
    """Places that boundaries of the last round cut, found from these alone; null where too many suffixes are behind them.

    A suffix q is the tail of back[q]; the place there is cut if the tail before it, before[back[q]], lies in front of the
    last boundary up to q. That is a fresh one only for the suffixes from it to the next boundary.
    """
    i = back[fresh]
    found = [i[before[i] < fresh]]
    p = fresh[~boundary[fresh + 1]]
    if len(p):
        every = np.flatnonzero(boundary)
        lens = every[np.searchsorted(every, p, "right")] - p - 1
        ends = np.cumsum(lens)
        if ends[-1] * 3 > len(back):
            return None
        first = np.repeat(p, lens)
        i = back[first + (np.arange(ends[-1]) - np.repeat(ends - lens, lens) + 1)]
        found.append(i[before[i] < first])
    out = np.concatenate(found)
    return out[~boundary[out]]


def repeated_windows(blocks: list[bytes], length: int = LENGTH, copies: np.ndarray | None = None) -> list[np.ndarray]:
    """For each byte string, the places where a window starts that also starts elsewhere in any of them.

    A string that stands for several copies enters the transform once; each of its suffixes counts as often in the
    intervals, so one that is alone in its interval is repeated too.

    The suffix order is settled to `length` bytes only; order among suffixes with equal windows doesn't matter for the
    intervals of shorter prefixes.
    """
    k = len(blocks)
    sizes = np.array([*map(len, blocks)])
    total = int(sizes.sum()) + k
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(total + 8, np.uint16)
    inside = np.ones(total, bool)
    inside[ends] = False
    text[:total][inside] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.uint16) + 1
    to_end = np.repeat(ends, sizes + 1) - np.arange(total)

    # seven symbols of nine bits; suffixes that end within them differ from all others
    key = np.zeros(total, np.uint64)
    for j in range(7):
        s = text[j : j + total].astype(np.uint64)
        if j:
            s[to_end < j] = 0
        key = key << np.uint64(9) | s
    order = np.argsort(key)
    have = 7
    new = np.ones(total, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    new |= to_end[order] < have
    # a suffix's rank is the first slot of its group
    rank = np.empty(total, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(total), 0))
    # only groups of several suffixes are sorted further; they keep the slots that their group has
    while have < length:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        part = order[slots]
        group = rank[part]
        second = np.where(part + have < total, rank[np.minimum(part + have, total - 1)] + 1, 0)
        moved = np.argsort(group * (total + 1) + second)
        part, group, second = part[moved], group[moved], second[moved]
        order[slots] = part
        cut = np.ones(len(slots), bool)
        cut[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        have *= 2
        cut |= to_end[part] < have
        new[slots] = cut
        rank[part] = np.maximum.accumulate(np.where(cut, slots, 0))

    # the transform: the symbol before each suffix. A stable sort of it gives, for each suffix, the place of its tail, the
    # suffix without its first symbol; suffixes that start with a mark have none that matters
    bwt = np.where(order > 0, text[order - 1], 0).astype(np.uint16)
    tail = np.argsort(bwt, kind="stable")
    head = text[order]

    # boundary[i]: suffixes i - 1 and i are known to differ within the bytes of the rounds so far
    boundary = np.zeros(total + 1, bool)
    boundary[0] = boundary[total] = True
    boundary[1:total] = (head[1:] != head[:-1]) | (head[1:] == 0)
    open_ = np.flatnonzero(~boundary[:total])
    low, high = tail[open_ - 1], tail[open_]
    back = np.empty(total, np.int32)
    back[tail] = np.arange(total, dtype=np.int32)
    before = np.roll(tail, 1).astype(np.int32)
    fresh = np.flatnonzero(boundary[:total])
    for _ in range(length - 1):
        # an interval of prefixes of l bytes, extended backwards by a byte, is cut where a boundary lies between the tails
        after = _cut_by(fresh, boundary, before, back) if len(fresh) * 16 < total else None
        if after is None:
            number = np.cumsum(boundary[:total], dtype=np.int32)
            cut = number.take(low) != number.take(high)
            after = open_.take(np.flatnonzero(cut))
            after = after[~boundary[after]]
            # those that are cut are cut again until they are swept out, which is done when there are many
            if np.count_nonzero(cut) * 8 > len(cut):
                keep = ~cut
                open_, low, high = open_[keep], low[keep], high[keep]
        if not len(after):
            break
        boundary[after] = True
        fresh = after
    open_ = open_[~boundary[open_]]
    shared = np.zeros(total, bool)
    shared[open_] = True
    shared[open_ - 1] = True
    if copies is not None:
        # the members of an interval of one suffix are its string's copies
        shared |= np.repeat(copies, sizes + 1)[order] > 1
    at = np.sort(order[shared])
    at = at[to_end[at] >= length]
    owner = np.searchsorted(ends, at)
    local = at - (ends - sizes)[owner]
    cuts = np.searchsorted(owner, np.arange(k + 1))
    return [local[cuts[i] : cuts[i + 1]] for i in range(k)]


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers in a sorted array."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first = np.concatenate([[0], cut])
    return places[first], np.diff(np.concatenate([first, [len(places)]]))


def union(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the ranges cover; touching ranges are one."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(starts[1:] > stops[:-1]) + 1
    return starts[np.concatenate([[0], cut])], stops[np.concatenate([cut - 1, [len(stops) - 1]])]


_SEGMENT = "h long, c long, k1 long, k2 long, start int, n int"


def _segment_rows(docs: DataFrame, gram: int, length: int, only_hash: bool) -> DataFrame:
    """Segments of docs (k1, k2, text, and ranges of window starts or null for all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(2))
            ranges = b.column(3).to_pylist()
            flat, starts, stops, row_of, off = [], [], [], [], 0
            for i, (t, r) in enumerate(zip(texts, ranges, strict=True)):
                flat.append(t)
                if len(t) >= length:
                    for s, n in [(0, len(t) - length + 1)] if r is None else [(x["start"], x["n"]) for x in r]:
                        starts.append(off + s)
                        stops.append(off + s + n)
                off += len(t)
            base = np.cumsum([0, *map(len, texts)])
            where = b"".join(flat), np.array(starts, np.int64), np.array(stops, np.int64), gram, length
            if only_hash:
                # a segment that may repeat its own windows counts twice
                yield pa.RecordBatch.from_arrays([pa.array(segments(*where, hash_only=True).view(np.int64))], names=["h"])
                continue
            h, c, s, n = segments(*where)
            row_of = np.searchsorted(base, s, side="right") - 1
            k1, k2 = (np.asarray(b.column(i))[row_of] if len(s) else np.array([], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), k1, k2, (s - base[row_of]).astype(np.int32), n.astype(np.int32))], names=["h", "c", "k1", "k2", "start", "n"])

    return docs.mapInArrow(run, "h long" if only_hash else _SEGMENT)


def _expand(bodies: DataFrame, length: int, block: int) -> DataFrame:
    """h, c, runs (start, n) of repeated windows of the segments (h, c, copies, body) of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def work(rows):
            places = repeated_windows([r[3] for r in rows], length, np.array([r[2] for r in rows]))
            out = [(r[0], r[1], [{"start": int(s), "n": int(n)} for s, n in zip(*runs(p), strict=True)]) for r, p in zip(rows, places, strict=True) if len(p)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], kind)], names=["h", "c", "runs"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and size >= block and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield work(held)

    return bodies.mapInArrow(run, "h long, c long, runs array<struct<start int, n int>>")


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """h, c, copies and the bytes of the segments in wanted (h, c, copies, at: k1, k2, start, n)."""
    by_doc = wanted.select(F.col("at.k1").alias("w1"), F.col("at.k2").alias("w2"), F.struct("h", "c", "copies", F.col("at.start").alias("start"), F.col("at.n").alias("n")).alias("x")).groupBy("w1", "w2").agg(F.collect_list("x").alias("xs"))
    rows = docs.join(by_doc, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("text", "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, xs in zip(text_bytes(b.column(0)), b.column(1), strict=True):
                x = xs.values
                start, n = np.asarray(x.field("start")), np.asarray(x.field("n"))
                yield pa.RecordBatch.from_arrays([x.field("h"), x.field("c"), x.field("copies"), pa.array([t[s : s + m + length - 1] for s, m in zip(start.tolist(), n.tolist(), strict=True)], pa.binary())], names=["h", "c", "copies", "body"])

    return rows.mapInArrow(run, "h long, c long, copies int, body binary")


def repeated_runs(docs: DataFrame, length: int = LENGTH, grams: tuple[float, ...] = GRAMS, most: int = MOST_SEGMENTS, block: int = BLOCK) -> DataFrame:
    """k1, k2, spans (start, stop) of the covered bytes of docs (k1, k2, text); spans may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "array<struct<start int, n int>>"
    todo = docs.select("k1", "k2", "text", F.lit(None).cast(kind).alias("ranges"))
    found, wide_before = [], None
    for i, share in enumerate(grams):
        gram = max(1, round(length * share))
        # hashes that occur more than once: the segments of all others have nothing repeated
        many = materialize(_segment_rows(todo, gram, length, True).groupBy("h").count().where("count > 1").select("h"), "hashes")
        hits = materialize(_segment_rows(todo, gram, length, False).join(many, "h", "left_semi"), "segments")
        distinct = materialize(hits.groupBy("h", "c").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("at")), "contents")
        last = i == len(grams) - 1
        wide = None
        wanted = distinct
        if not last:
            wide = materialize(distinct.groupBy("h").count().where(F.col("count") > most).select("h"), "wide")
            wanted = distinct.join(wide, "h", "left_anti")
        bodies = _bodies(docs, wanted, length).repartition(parts, "h").sortWithinPartitions("h", "c")
        marked = materialize(_expand(bodies, length, block), "marked")
        spans = hits.join(marked, ["h", "c"]).select("k1", "k2", F.explode(F.transform("runs", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["start"] + x["n"] + F.lit(length - 1)).alias("stop")))).alias("x"))
        found.append(materialize(spans.groupBy("k1", "k2").agg(F.collect_set("x").alias("spans")), "spans"))
        discard(many, distinct, marked)
        if wide_before is not None:
            discard(wide_before)
        if last or wide.isEmpty():
            discard(hits)
            break
        again = materialize(hits.join(wide, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("ranges")), "again")
        discard(hits, wide)
        wide_before = again
        todo = docs.join(again, ["k1", "k2"]).select("k1", "k2", "text", "ranges")
    if len(found) == 1:
        return found[0]
    both = found[0]
    for x in found[1:]:
        both = both.unionByName(x)
    return materialize(both.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with k1 and k2, which tell rows apart by key and text; repeated rows share them."""
    return docs.withColumn("k1", F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))).withColumn("k2", F.xxhash64(F.col(key).cast("string"), F.col(text)))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, whole_characters: bool = False, **how) -> DataFrame:
    """docs with n_bytes, removed (start, stop of each maximal run) and kept (the other bytes) of every row.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another;
    both are judged on the input. Texts are UTF-8 bytes; null is empty; shorter texts lose nothing. Repeated rows are
    texts of their own, so each one's long strings are repeated. With whole_characters, kept also lacks the rest of
    characters that lose a byte. Columns of docs with the new names are replaced; all others stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.columns
    plain = docs.toDF(*[f"o{i}" for i in range(len(own))])
    key_at, text_at = f"o{own.index(key)}", f"o{own.index(text)}"
    rows = keyed(plain, key_at, text_at)
    spans = repeated_runs(rows.select("k1", "k2", F.col(text_at).alias("text")), length, **how)
    joined = rows.join(spans.withColumnRenamed("k1", "s1").withColumnRenamed("k2", "s2"), (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select(*plain.columns, "spans")

    def one(t: bytes, x) -> tuple[list[dict], bytes]:
        if not x.is_valid:
            return [], t
        v = x.values
        a, z = (e.tolist() for e in union(np.asarray(v.field("start")), np.asarray(v.field("stop"))))
        gone = [{"start": p, "stop": q} for p, q in zip(a, z, strict=True)]
        if whole_characters:
            inner = lambda i: 0 < i < len(t) and t[i] & 0xC0 == 0x80
            for i in range(len(a)):
                while inner(a[i]):
                    a[i] -= 1
                while inner(z[i]):
                    z[i] += 1
        edges = [0, *[e for p, q in zip(a, z, strict=True) for e in (p, q)], len(t)]
        return gone, b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))

    def make():
        def work(texts: pa.Array, found: pa.Array):
            plain_texts = text_bytes(texts)
            made = [one(t, x) for t, x in zip(plain_texts, found, strict=True)]
            return [[len(t) for t in plain_texts], [m[0] for m in made], [m[1] for m in made]]

        return work

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    fields = [T.StructField("x_bytes", T.LongType()), T.StructField("x_removed", span), T.StructField("x_kept", T.BinaryType())]
    out = with_columns_from(joined, [text_at, "spans"], make, fields)
    new = ["n_bytes", "removed", "kept"]
    left = [(f"o{i}", c) for i, c in enumerate(own) if c not in new]
    return out.select(*[a for a, _ in left], "x_bytes", "x_removed", "x_kept").toDF(*[c for _, c in left], *new)
