"""Near copies by exact shingle similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

``signed`` (a node per text, its SimHash and 32 MinHash bands of five) -> ``close`` (Golay-code keys: SimHashes connected
within four bits are one group) -> ``candidates`` (nodes that share a group or a band) -> verification on the whole shingle
sets -> components. Every similar pair within four bits is found. The bands are for the rest, as most pairs at 0.8 differ
in more bits: beyond four, a pair at exactly 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6, one of more
similarity less often; no other pair of that similarity is left out, and no other pair is linked.

Words are compared as in ``simhash``: lower case in ASCII, any white space. Null and empty texts are one node; a text
of fewer words is one shingle. Equal texts are one node. A band or group of many nodes first links each to its first and
to its neighbour; where that leaves several components, all its pairs across them are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.graph import heavy_keys, roots, spread_join
from tidemark.llm.simhash import PARTITION_KEYS, links
from tidemark.llm.textkernel import cut, few_files, mix, over_text, shuffle_partitions

WORDS = 5
#: Least similarity, as a fraction of integers.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
#: Rows with a text or with its shingles that one file holds.
TEXT_ROWS = 10_000
#: Pairs of rows with two sets of shingles that one task verifies.
PAIR_ROWS = 2_000
#: Nodes of one band whose pairs are all listed.
PAIRS_OF = 32
#: Nodes and bytes of shingles that a task compares at once.
BLOCK_NODES, BLOCK_BYTES = 2000, 32 << 20


def _joined(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def shingles(joined: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of all word shingles, sorted; of the whole where there are fewer words."""
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, each counted once: bits set in over half of them; signed, as Spark's long holds it."""
    on = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        on += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(on * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band of the minima of BANDS * ROWS orders."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        x = hashes[None, i : i + 2048] * factors[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ part)
    return key


def signed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, node, fp (long) and bands (binary) of each whole text; no bands for a text of no words."""

    def make():
        factors = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def work(texts: pa.Array) -> list[pa.Array]:
            all_joined = [_joined(t.as_py()) for t in texts.cast(pa.binary())]
            nodes = np.array([xxhash.xxh64_intdigest(t, 7) for t in all_joined], np.uint64)
            fps, keys = [], []
            for t in all_joined:
                own = shingles(t)
                fps.append(fingerprint(own))
                keys.append(bands(own, factors).tobytes() if t else b"")
            return [pa.array(nodes.view(np.int64)), pa.array(fps, pa.int64()), pa.array(keys, pa.binary())]

        return work

    return over_text(docs, make, "node long, fp long, bands binary", keep)


def _keyed(batches):
    for batch in batches:
        node, own = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        n = [len(x) // 8 for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(own), np.int64)), pa.array(np.repeat(node, n))], ["key", "node"])


def close(nodes: DataFrame, rows: int, radius: int = golay.RADIUS) -> DataFrame:
    """key, node: nodes whose fingerprints are connected within ``radius`` bits share a key. Nodes of no words have none."""
    nodes = nodes.filter(F.length("bands") > 0).select("fp", "node")
    fps = cut(nodes.groupBy("fp").agg(F.count("*").alias("n")), rows)
    root = roots(links(fps, radius)).withColumnRenamed("node", "fp")
    return spread_join(nodes, root, "fp", heavy_keys(fps, "fp", "n"), "left").select(F.coalesce("root", "fp").alias("key"), "node")


PAIR, MEMBER = 0, 1


def _found(a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])


def _grouped(limit: int):
    """Rows sorted by key and node -> pairs of nodes. Of a key of over ``limit`` nodes also all rows, as members."""

    def listed(k, f):
        for lag in range(1, limit):
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            yield _found(f[:-lag][same], f[lag:][same], PAIR)

    def crowded(key, lead, chain):
        """``chain``: the node before, then new ones."""
        new = chain[1:]
        yield _found(np.full(len(new), lead), new, PAIR)
        yield _found(chain[:-1], new, PAIR)
        yield _found(np.full(len(new), key), new, MEMBER)

    def kernel(batches):
        k, f, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            nk, nf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if over is not None:
                key, lead, last = over
                own = int(np.searchsorted(nk, key, "right"))
                yield from crowded(key, lead, np.append(last, nf[:own]))
                over = (key, lead, nf[own - 1]) if own else over
                nk, nf = nk[own:], nf[own:]
            k, f = np.concatenate([k, nk]), np.concatenate([f, nf])
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            for i in np.flatnonzero(size > limit):
                rows = f[first[i] : first[i] + size[i]]
                yield _found(k[first[i] : first[i] + 1], rows[:1], MEMBER)
                yield from crowded(k[first[i]], rows[0], rows)
            if size[-1] > limit:
                over = (k[-1], f[first[-1]], f[-1])
                size = size.copy()
                done = len(k)
            else:
                over, done = None, first[-1]
            whole = np.repeat(size <= limit, size)[:done]
            yield from listed(k[:done][whole], f[:done][whole])
            k, f = k[done:], f[done:]
        yield from listed(k, f)

    return kernel


def candidates(nodes: DataFrame, limit: int = PAIRS_OF) -> DataFrame:
    """a, b, kind: pairs of nodes that share a group of close fingerprints or a band (0), or one that is crowded and a node of it (1)."""
    rows = nodes.count()
    n = rows * (BANDS + 1)
    parts = max(shuffle_partitions(nodes.sparkSession), -(-n // PARTITION_KEYS))
    keyed = nodes.select("node", "bands").mapInArrow(_keyed, "key long, node long").unionByName(close(nodes, rows))
    return cut(keyed.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(_grouped(limit), "a long, b long, kind int"), n, PARTITION_KEYS)


def alike(both, size_a, size_b):
    """Whether sets of these sizes with ``both`` in common are similar enough."""
    return both * SIMILARITY[1] >= (size_a + size_b - both) * SIMILARITY[0]


def _verify(batches):
    for batch in batches:
        a, b, keep = batch.column(0), batch.column(1), []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n, m = len(x) // 8, len(y) // 8
            keep.append(bool(alike(min(n, m), n, m)) and bool(alike(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)), n, m)))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def across(label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Indexes of similar sets that connect all labels which have any; sets of one label are not compared."""
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    _, label, count = np.unique(label, return_inverse=True, return_counts=True)
    held, out = np.zeros(len(values), bool), []
    for i in np.flatnonzero(label != count.argmax()):
        own = ids[starts[i] : starts[i] + size[i]]
        held[own] = True
        near = alike(np.add.reduceat(held[ids], starts, dtype=np.int64), size, size[i]) & (label != label[i])
        held[own] = False
        out += [(int(i), int(j)) for j in np.flatnonzero(near)[np.unique(label[near], return_index=True)[1]]]
    return out


def _blocks(batches):
    """Rows sorted by group: group, node, label, set -> links across labels."""
    rows: list[tuple] = []

    def done():
        pairs = across(np.array([r[2] for r in rows]), [np.frombuffer(r[3], np.uint64) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][1] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] != r[0]:
                yield done()
                rows.clear()
            rows.append(r)
    if rows:
        yield done()


def _labels(edges: DataFrame) -> DataFrame:
    return roots(edges).withColumnRenamed("root", "label")


def _links_of_crowds(members: DataFrame, label: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """a, b: similar nodes of one crowded band or group that are not in one component yet."""
    rows = members.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    rows = rows.join(sets.select("node", F.length("set").alias("bytes")), "node")
    n = F.ceil(F.greatest(F.count("*") * 2 / block, F.sum("bytes") * 2 / BLOCK_BYTES)).cast("int")
    keys = rows.groupBy("key").agg(n.alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "n")
    own = rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = own.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    pairs = pairs.select(group.alias("group"), "node", "label").join(sets, "node").select("group", "node", "label", "set")
    parts = shuffle_partitions(members.sparkSession)
    return cut(pairs.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_blocks, "a long, b long"))


def keep_one(docs: DataFrame, limit: int = PAIRS_OF, block: int = BLOCK_NODES) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, a row without one only where none has one. Same columns.

    Different texts under one doc_id are rows of their own; equal rows of a doc_id count once."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    key = ["__none", "__id", "__h"]  # equalities, so that joins and the removal of repeats share one shuffle
    marked = docs.withColumns({"__none": own["none"], "__id": own["id"], "__h": own["h"]})
    split = [F.col("row.none").alias("__none"), F.col("row.id").alias("__id"), F.col("row.h").alias("__h")]
    rows = docs.count()
    nodes = cut(signed(docs.select(own.alias("row"), "text"), ["row"]).groupBy("node").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), rows, TEXT_ROWS)
    found = candidates(nodes, limit)
    pairs = cut(found.filter(F.col("kind") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), found.count())
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = marked.select(*key, "text").join(nodes.join(named, "node").select("node", *split), key).dropDuplicates(key)

    def make():
        return lambda t: [pa.array([shingles(_joined(x.as_py())).tobytes() for x in t.cast(pa.binary())], pa.binary())]

    sets = cut(over_text(texts, make, "set binary", ["node"]), rows, TEXT_ROWS)
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    edges = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long"), pairs.count(), PAIR_ROWS)
    label = _labels(edges)
    members = found.filter(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node"))
    if not members.isEmpty():
        more = _links_of_crowds(members, label, sets, block)
        if not more.isEmpty():
            label = _labels(edges.unionByName(more.distinct()))
    kept = nodes.select("node", "row").join(label, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("row").alias("row"))
    return few_files(marked.join(kept.select(*split), key, "left_semi").dropDuplicates(key).select(*docs.columns), rows, TEXT_ROWS)
