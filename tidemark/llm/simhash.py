"""SimHash near-dedup with Golay-code fuzzy keys.

``fingerprints`` -> ``links`` (a star in each run of one key, of fingerprints within four bits) -> ``graph.roots`` -> smallest id.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal texts share a
fingerprint, hence a component; rows that share a doc_id are each returned. An empty table gives an empty result. A bit
set in exactly half the shingles is 0. Very long texts are hashed whole, in memory linear in the text. Other columns are ignored.
Work is on distinct fingerprints, so a group of exact copies of any size is one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay
from tidemark.llm.graph import heavy_keys, least_of, roots, spread_join
from tidemark.llm.textkernel import cut, few_files, over_text, shuffle_partitions

#: Fingerprints of one key that a task compares at once; keys with more are cut in blocks, see ``links``.
GROUP_LIMIT = 20_000
#: Links that a task holds to drop those that others of its own imply.
HELD_LINKS = 1 << 20
#: Keys that one partition of the candidate shuffle should hold.
PARTITION_KEYS = 1_000_000


def text_simhash(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; signed, as Spark's long holds it."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) <= words:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int32) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """Columns ``keep`` (doc_id by default), then ``name`` (long): the SimHash of each whole text."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            raw = (t.as_py() for t in texts.cast(pa.binary()))
            return [pa.array(np.fromiter((text_simhash(t, words) if t else 0 for t in raw), np.int64, len(texts)))]

        return work

    return over_text(docs, make, f"{name} long", keep or ["doc_id"])


def _keyed(fps: DataFrame) -> DataFrame:
    def kernel(batches):
        t = golay.tables()
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 2048):
                part = fp[i : i + 2048]
                row, key = golay.keys(part.view(np.uint64), t)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    return fps.select("fp").mapInArrow(kernel, "key long, fp long")


def _spanning(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints reachable within radius; each reached one is compared once with the rest."""
    left = np.unique(fp)
    out_a, out_b = [], []
    while len(left) > 1:
        seed, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                got = left[near]
                out_a.append(np.full(len(got), seed))
                out_b.append(got)
                front.extend(got.tolist())
                left = left[~near]
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(k: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys, rows sorted by key and fingerprint: a star about the smallest of each component of a run."""
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    out = []
    for i in np.flatnonzero(size > 24):
        out.append(_spanning(f[first[i] : first[i] + size[i]], radius))
    keep = np.repeat((size > 1) & (size <= 24), size)
    k, f, near = k[keep], f[keep], []
    for lag in range(1, len(k)):
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        at = np.flatnonzero(same)
        at = at[np.bitwise_count((f[at] ^ f[at + lag]).view(np.uint64)) <= radius]
        near.append((at, at + lag))
    if near:
        i, j = (np.concatenate(x) for x in zip(*near))
        label = np.arange(len(f))
        while (label[i] != label[j]).any():
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        at = np.flatnonzero(label != np.arange(len(f)))
        out.append((f[label[at]], f[at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*out))
    return a, b


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what these connect: a star about the smallest of each component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        for ends in (label[i], label[j]):
            np.minimum.at(label, ends, low)
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[linked]], ids[linked]


def _linker(radius: int, limit: int):
    """Streams rows sorted by key and fingerprint; a key with over ``limit`` rows is reported (kind 1) instead of compared."""

    def batch_of(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    def kernel(batches):
        k, f, over, found, n = np.zeros(0, np.int64), np.zeros(0, np.int64), None, [], 0
        for batch in batches:
            nk, nf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if over is not None:
                rest = nk != over
                nk, nf = nk[rest], nf[rest]
            k, f = np.concatenate([k, nk]), np.concatenate([f, nf])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1], "left"))
            if last:
                found.append(_compare(k[:last], f[:last], radius))
                n += len(found[-1][0])
                k, f = k[last:], f[last:]
                if n > HELD_LINKS:
                    found = [_forest(*(np.concatenate(x) for x in zip(*found)))]
                    n = len(found[0][0])
                    if n > HELD_LINKS // 2:
                        yield batch_of(*found.pop(), 0)
                        n = 0
            if len(k) > limit:
                over = k[0]
                yield batch_of(k[:1], f[:1], 1)
                k, f = k[:0], f[:0]
        found.append(_compare(k, f, radius))
        yield batch_of(*_forest(*(np.concatenate(x) for x in zip(*found))), 0)

    return kernel


def links(fps: DataFrame, radius: int = golay.RADIUS, limit: int = GROUP_LIMIT) -> DataFrame:
    """a, b (long): edges between distinct fingerprints that connect all those within ``radius`` bits.

    ``fps`` has one row per distinct fp and should be materialised. The shuffle on Golay keys streams
    through tasks in key order. A key with over ``limit`` fingerprints is dealt with in a second pass:
    its rows are cut in blocks by hash and each pair of blocks is compared in a group of its own."""
    spark = fps.sparkSession
    n = fps.count() * 190
    parts = max(shuffle_partitions(spark), -(-n // PARTITION_KEYS))
    keyed = _keyed(fps)
    schema = "a long, b long, kind int"
    found = cut(keyed.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(radius, limit), schema), n, PARTITION_KEYS)
    edges = found.filter("kind = 0").select("a", "b")
    over = found.filter("kind = 1").select(F.col("a").alias("key"))
    if not over.isEmpty():
        hot = keyed.join(over, "key", "left_semi")
        blocks = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / limit).cast("int").alias("n"))
        own = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        pairs = own.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
        group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        pairs = pairs.select(group.alias("key"), "fp")
        more = pairs.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_linker(radius, 1 << 62), schema)
        edges = edges.unionByName(more.select("a", "b"))
    return edges.distinct()


def groups(fps: DataFrame, radius: int = golay.RADIUS) -> tuple[DataFrame, DataFrame]:
    """fp, component_id (smallest doc_id of its component) for each distinct fp of (doc_id, fp); and which fps have very many rows.

    Fingerprints are the nodes, so rows without a doc_id link others like any row; a component of such rows only has
    no component_id."""
    rows = fps.count()
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), rows)
    linked = roots(links(distinct, radius)).withColumnRenamed("node", "fp")
    linked = least_of(linked.join(distinct.select("fp", "first"), "fp"), "first").select("fp", "least")
    own = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    own = cut(own, rows)  # else a join with it on fp shares this join's stage, where Spark cannot split a hot fp
    return own, heavy_keys(distinct, "fp", "n")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = golay.RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id: one row per row of docs."""
    fps = cut(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words))
    own, heavy = groups(fps, radius)
    return few_files(spread_join(fps, own, "fp", heavy).select("doc_id", "fp", "component_id"), fps.count())
