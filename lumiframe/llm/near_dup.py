"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join over them, and exact links on full sets.

A signature has SYMBOLS symbols of 16 bits. Two of them are near if at most NEAR symbols differ. Cut into CHUNKS
chunks, near signatures have a chunk with at most NEAR // CHUNKS = 1 errors; so every chunk is indexed once for each
symbol that may be wrong, and all near pairs share a key. At similarity s a symbol differs with probability 1 - s: more
than 15 of 32 do with 1.4e-4 at 0.8 and 3.5e-6 at 0.85; larger groups are connected by many pairs.

Large buckets and candidate groups are worked off in two rounds. First they are dealt to blocks, and each block meets
the first one, the pivots, in a task of its own: rows are shipped about twice, whatever the group's size. As near
copies mostly lie near some pivot, that mostly connects a group. Then only what its task didn't connect with the
pivots' largest component meets all other blocks, so that no pair goes unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.llm.common import bounded_batches, discard, materialize, text_bytes
from lumiframe.llm.components import components

#: Words of a shingle; symbols of a signature, its chunks, and the symbols that may differ; the link's percentage.
WIDTH, SYMBOLS, CHUNKS, NEAR, PERCENT = 5, 32, 8, 15, 80
#: Members of a bucket, and members and shingles of a candidate group, that one task compares; larger ones are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: lower-cased ASCII, words between ASCII white space.

    Fewer words than `width` are one shingle; no word gives no shingle.
    """
    import xxhash

    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), dtype=np.uint64)
    if not len(w):
        return w
    k = min(width, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _mixed(acc * _M + w[j : len(w) - k + 1 + j])
    return np.unique(acc)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signer(symbols: int = SYMBOLS):
    """A function from a set of shingle hashes to its signature, as bytes."""
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 63, (2, symbols), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(s: np.ndarray) -> bytes:
        least = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 4096):
            np.minimum(least, (s[i : i + 4096, None] * a + b).min(0), out=least)
        return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()

    return sign


def text_id(text: str = "text") -> F.Column:
    """Tells apart the texts that stand under one key."""
    return F.xxhash64(F.col(text))


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_id, signature, text_id (a hash of the text) of each row; set and signature are null where there is no shingle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer()
        for b in batches:
            sets = [shingles(t, width) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([sign(s) if len(s) else None for s in sets], pa.binary()), b.column(2)],
                names=["doc_id", "n_shingles", "set_id", "signature", "text_id"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_id(text).alias("text_id")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary, text_id long")


def index_keys(signature: str = "signature") -> F.Column:
    """Keys of a signature: for each chunk, and each of its symbols that may be wrong, a hash of the others."""
    size = 2 * SYMBOLS // CHUNKS
    keys = []
    for c in range(CHUNKS):
        for j in range(size // 2):
            before = F.substring(signature, c * size + 1, 2 * j)
            after = F.substring(signature, c * size + 2 * j + 3, size - 2 * j - 2)
            keys.append(F.xxhash64(F.lit(c * 64 + j), F.concat(before, after)))
    return F.array(*keys)


def spanning(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on 0..n-1 in which near(x, rest) gives which of `rest` x is linked with.

    A node is compared only with those that nothing has reached yet, so a group of copies costs its size, not its square.
    """
    rest = np.arange(n)
    edges = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            found = rest[hit]
            if len(found):
                edges += [(x, y) for y in found]
                queue += found.tolist()
                rest = rest[~hit]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of a stream sorted by its first n_keys columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [np.asarray(b.column(i)) for i in range(n_keys)]
        if held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(keys)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = [table.column(i).to_numpy() for i in range(n_keys)]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if table.num_rows > 1 else np.array([], int)
    return np.concatenate([[0], change, [table.num_rows]])


def _largest_component(n: int, edges: list[tuple[int, int]], among: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of the components of a forest on 0..n-1, and of these the label that most of `among` have (the first of equal ones)."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in edges:
        top[root(y)] = root(x)
    label = np.array([root(x) for x in range(n)])
    return label, (np.bincount(label[among]).argmax() if len(among) else -1)


def _compare(n: int, near, pivot: np.ndarray | None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest, and the nodes that it doesn't connect with the pivots' largest component.

    That component is found among the pivots alone, so all tasks of a group, which see the same pivots in the same order,
    mean the same one. Without pivots nothing is left.
    """
    edges = spanning(n, near)
    if pivot is None:
        return edges, np.array([], int)
    at = np.flatnonzero(pivot)
    own = spanning(len(at), lambda i, rest: near(at[i], at[rest]))
    label, top = _largest_component(len(at), own, np.arange(len(at)))
    core = at[label == top]
    label, top = _largest_component(n, edges, core)
    return edges, np.flatnonzero(label != top)


def _with_pivots(df: DataFrame, by: str) -> DataFrame:
    """Round one: each row of a group of `blocks` blocks in the task of its block, (0, block), and the first block's rows, the pivots, in all of them.

    A group of one block is task (0, 0).
    """
    own = F.pmod(F.xxhash64(F.col(by), F.lit("block")), F.col("blocks")).cast("int")
    out = df.withColumn("bi", F.lit(0)).withColumn("own_block", own)
    every = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("own_block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("own_block"))
    return out.withColumn("bj", F.explode(every)).withColumn("pivot", F.col("own_block") == 0).drop("own_block")


def _rest_pairs(members: DataFrame, found: DataFrame, group: str, node: str) -> DataFrame | None:
    """Round two: group, node, bi, bj, pivot (null): what round one left apart in a group of several blocks, against all of the group.

    members: group, node, blocks, per_block; found: rows (a, null, group) of the nodes left apart. Null if there are
    none. They are dealt to blocks of about `per_block` rows; block i of them meets block j of the whole group in task (i, j).
    """
    left = found.where("b is null")
    if left.isEmpty():
        return None
    left = left.select(F.col("grp").alias("l_group"), F.col("a").alias("l_node")).distinct()
    counts = materialize(left.groupBy("l_group").agg(F.count(F.lit(1)).alias("l_n")), "left")
    open_ = members.join(counts, F.col(group) == F.col("l_group")).withColumn("n_rest", F.ceil(F.col("l_n") / F.col("per_block")).cast("int"))
    at = lambda n: F.pmod(F.xxhash64(F.col(node), F.lit("rest")), F.col(n)).cast("int")
    others = open_.withColumn("bj", at("blocks")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)))
    rest = open_.drop("l_group").join(left, (F.col(group) == F.col("l_group")) & (F.col(node) == F.col("l_node"))).withColumn("bi", at("n_rest")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = [group, node, "bi", "bj"]
    out = materialize(others.select(*own).unionByName(rest.select(*own)).distinct().withColumn("pivot", F.lit(None).cast("boolean")), "rest")
    discard(counts)
    return out


def candidate_edges(classes: DataFrame, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """a, b: edges that connect all pairs of classes (rep, signature) whose signatures differ in at most `near` symbols.

    Equal signatures are one member of the index, linked with the smallest class that has it. Of a bucket's near pairs a
    spanning forest is given. `near` is at most 2 * CHUNKS - 1. Rows shipped: 4 * CHUNKS keys a signature that shares
    one, twice those in buckets beyond a block, and what _rest_pairs() tells. Classes without a signature have no edge.
    """
    if near // CHUNKS > 1:
        raise ValueError(f"near is at most {2 * CHUNKS - 1}")
    classes = classes.where("signature is not null")
    first = materialize(classes.groupBy("signature").agg(F.min("rep").alias("rep")), "signatures")
    equal = classes.join(first.select(F.col("signature").alias("f_signature"), F.col("rep").alias("a")), F.col("signature") == F.col("f_signature")).where("rep <> a").select("a", F.col("rep").alias("b"))
    keyed = first.select("rep", F.explode(index_keys()).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialize(keyed.join(shared, "key").select("key", "rep", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.lit(block).alias("per_block")), "members")
    signatures = first.select("rep", "signature")
    dealt = lambda places: _near_edges(places.join(signatures, "rep").select("key", "bi", "bj", "rep", "signature", "pivot"), near)
    one = dealt(_with_pivots(members, "rep"))
    rest = _rest_pairs(members, one, "key", "rep")
    more = [] if rest is None else [dealt(rest)]
    edges = equal
    for x in [one, *more]:
        edges = edges.unionByName(x.where("b is not null").select("a", "b"))
    out = materialize(edges.distinct(), "candidates")
    discard(first, shared, members, one, *more, *([] if rest is None else [rest]))
    return out


#: Rows of a task's findings: edges (a, b, null), and nodes that are left apart (a, null, group).
_FOUND = "a long, b long, grp long"


def _found(a, b, apart: list, groups: list) -> pa.RecordBatch:
    n, m = len(a), len(apart)
    return pa.RecordBatch.from_arrays([pa.array([*a, *apart], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), pa.array([*[None] * n, *groups], pa.int64())], names=["a", "b", "grp"])


def _near_edges(dealt: DataFrame, near: int) -> DataFrame:
    """Findings on the near pairs of each task (key, bi, bj) of rows (..., rep, signature, pivot)."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            keys, bj, reps = (t.column(i).to_numpy() for i in (0, 2, 3))
            pivots = t.column(5).to_pylist()
            sigs = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            cuts = _groups(t, 3)
            sizes = np.diff(cuts)
            small = (sizes == 2) & (bj[cuts[:-1]] == 0)
            two = cuts[:-1][small]
            ok = two[(sigs[two] != sigs[two + 1]).sum(1) <= near]
            pairs, apart, groups = [np.stack([reps[ok], reps[ok + 1]])], [], []
            for s, n in zip(cuts[:-1][~small], sizes[~small], strict=True):
                x = sigs[s : s + n]
                pivot = None if bj[s] == 0 or pivots[s] is None else np.array(pivots[s : s + n], bool)
                e, left = _compare(n, lambda i, rest, x=x: (x[i] != x[rest]).sum(1) <= near, pivot)
                if e:
                    pairs.append(reps[s + np.array(e).T])
                apart += reps[s + left].tolist()
                groups += [int(keys[s])] * len(left)
            out = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
            yield _found(out[0].tolist(), out[1].tolist(), apart, groups)

    return materialize(dealt.mapInArrow(run, _FOUND), "near-edges")


def exact_links(docs: DataFrame, groups: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: edges that connect all pairs within a group that are linked on full sets: 100 * intersection >= percent * union.

    docs: doc_id, text; groups: rep (a doc_id, null where its texts have none), set_id, n_shingles, group. Where a doc_id
    stands on different texts, groups also has text_id, which says whose set it is, and node, which the edges then
    connect instead of rep. A group beyond a block's members or shingles is worked off in the two rounds of this module,
    so each of its texts is shipped about twice, and once more for each block of those that round one left apart.
    """
    sizes = groups.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / block_shingles), F.lit(1)).cast("int").alias("blocks"), F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(block_shingles) * F.count(F.lit(1)) / F.greatest(F.lit(1), F.sum("n_shingles"))))).cast("int").alias("per_block"))
    node = F.col("node" if "node" in groups.columns else "rep").alias("node")
    told = [c for c in groups.columns if c == "text_id"]
    dealt = materialize(groups.join(sizes, "group").select("rep", node, "set_id", "group", "blocks", "per_block", *told), "groups")
    texts = docs.select(F.col("doc_id").alias("t_rep"), *[text_id().alias(f"t_{c}") for c in told], "text")
    same = F.col("t_rep").eqNullSafe(F.col("rep"))
    for c in told:
        same = (F.col(f"t_{c}") == F.col(c)) & same

    def compare(places: DataFrame) -> DataFrame:
        # the groups grow with the corpus, so they are never broadcast: texts are shuffled once, at every size
        rows = texts.hint("merge").join(places, same).select("group", "bi", "bj", "node", "set_id", "text", "pivot")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, "group", "bi", "bj").sortWithinPartitions("group", "bi", "bj", "node")
        bounded_batches(docs.sparkSession)
        return materialize(rows.mapInArrow(run, _FOUND), "links")

    def links(sets: list[np.ndarray], pivot: np.ndarray | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        n = len(sets)
        size = np.array([*map(len, sets)])
        starts = np.concatenate([[0], np.cumsum(size)])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        owner = np.repeat(np.arange(n), size)[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(ids))])

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            own = ids[starts[x] : starts[x + 1]]
            lens = first[own + 1] - first[own]
            ends = np.cumsum(lens)
            common = np.bincount(owner[np.repeat(first[own] - ends + lens, lens) + np.arange(ends[-1])], minlength=n)[rest]
            return 100 * common >= percent * (size[x] + size[rest] - common)

        return _compare(n, near, pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            cuts = _groups(t, 3)
            a, b, apart, names = [], [], [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                g = t.slice(s, e - s)
                sets, nodes, pivots, seen = [], [], [], set()
                for node, want, text, pivot in zip(g.column(3).to_pylist(), g.column(4).to_pylist(), text_bytes(g.column(5).combine_chunks()), g.column(6).to_pylist(), strict=True):
                    if node in seen:
                        continue
                    own = shingles(text, width)
                    if set_id(own) == want:
                        seen.add(node)
                        sets.append(own)
                        nodes.append(node)
                        pivots.append(pivot)
                several = g.column(2)[0].as_py() > 0 and pivots and pivots[0] is not None
                if len(sets) > 1 or several:
                    edges, left = links(sets, np.array(pivots, bool) if several else None)
                    a += [nodes[i] for i, _ in edges]
                    b += [nodes[j] for _, j in edges]
                    apart += [nodes[i] for i in left]
                    names += [g.column(0)[0].as_py()] * len(left)
            yield _found(a, b, apart, names)

    found = compare(_with_pivots(dealt, "node"))
    rest = _rest_pairs(dealt, found, "group", "node")
    edges = found.where("b is not null").select("a", "b")
    if rest is not None:
        more = compare(rest.select(F.col("group").alias("r_group"), F.col("node").alias("r_node"), "bi", "bj", "pivot").join(dealt, (F.col("r_group") == F.col("group")) & (F.col("r_node") == F.col("node"))))
        edges = materialize(edges.unionByName(more.where("b is not null").select("a", "b")), "links")
        discard(found, more, rest)
    discard(dealt)
    return edges


def _labelled(docs: DataFrame, key: str, text: str, percent: int, near: int) -> DataFrame:
    """doc_id, text_id, n_shingles of every row of docs, and first_id, first_text: those of the first document of its component.

    First is the smallest doc_id, and where no text has one, any but always the same. Both are null where there is no shingle.
    """
    spark = docs.sparkSession
    rows = materialize(profile(docs, key, text), "profile")
    # a least pair with the missing keys last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("first")
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(first, F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"))
    sets = materialize(sets.select("set_id", F.col("first.doc_id").alias("rep"), F.col("first.text_id").alias("text_id"), "signature", "n_shingles"), "sets")
    # a doc_id may stand on different texts, so classes are told apart by nodes: numbers in the order of doc_id and set
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("rep").asc_nulls_last(), F.col("set_id").asc()]
    classes = materialize(sets.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = candidate_edges(classes.select(F.col("node").alias("rep"), "signature"), near)
    found = components(edges)
    groups = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).select("node", F.col("component").alias("group"))
    groups = classes.drop("signature").join(groups, "node")
    links = exact_links(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), groups, percent)
    reached = components(links)
    head = classes.select(F.col("node").alias("component"), F.col("rep").alias("first_id"), F.col("text_id").alias("first_text"))
    labels = classes.select("set_id", "node").join(reached, "node", "left").select(F.col("set_id").alias("c_set"), F.coalesce("component", "node").alias("component")).join(head, "component").drop("component")
    labels = materialize(labels, "labels")
    discard(edges, sets, classes)
    return rows.join(labels, F.col("set_id") == F.col("c_set"), "left").select("doc_id", "text_id", "n_shingles", "first_id", "first_text")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; other columns are ignored.

    component_id is the smallest doc_id that links reach, itself included. Rows with equal sets are one class, so copies
    cost their count. Null, empty and blank texts have no shingle and no link. A row without a key links as any other,
    has its component's doc_id, null if none has one, and isn't kept. Repeated rows agree; rows of one doc_id with
    different texts are documents of their own, which only their texts link. Keys are numbers or text of whole numbers;
    other text raises.
    """
    out = _labelled(docs, key, text, percent, near).withColumn("component_id", F.when(F.col("first_text").isNotNull(), F.col("first_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def kept_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, near: int = NEAR) -> DataFrame:
    """doc_id, text_id of one text of each component, and of every text without a shingle; doc_id is null where no text of a component has one."""
    out = _labelled(docs, key, text, percent, near)
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_id") == F.col("first_text"))
    return out.where(F.col("first_text").isNull() | same).select("doc_id", "text_id").distinct()
