"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and a long line further where its content says so (the hash of a
word is 0 modulo ``PIECE_WORDS``), so an edit changes the pieces it touches and no others. Each distinct piece has a 64-bit
digest, added to one cell in each third of a small table of (count, xor of digests, xor of checks). Two
tables of one size subtract cell by cell; peeling single-digest cells recovers what the versions do not
share. The likeness of two texts comes from their fingerprints, sketches of ``CELLS`` cells, where their difference peels;
where it does not, both are sketched again with cells for all their digests, then with twice the cells. ``cells_edited``
and ``cells_next`` say at which size each difference was recovered.

Null and empty texts have no piece: the sketch is all zero, and two such texts have likeness 1. Order of
pieces and repeats do not count. Rows that share a doc_id follow one another in order of their text (of its hash); rows that share
both are alike. The next document of the smallest id is that of the largest; a single document is its own next. An empty table
gives an empty result. Very long texts are cut and sketched whole, in memory linear in the text. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import Powers, PrefixHash, cut, mix, passes, rows_of, shuffle_partitions, word_bounds

CELLS = 24
PIECE_WORDS = 8
HASHES = 3
#: A cell of an encoded sketch: count, xor of digests, low bits of the xor of checks.
CELL = np.dtype([("c", "<i4"), ("k", "<u8"), ("h", "<u2")])
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def piece_digests(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of all texts, text by text, and n+1 offsets."""
    offs = np.cumsum([0, *map(len, texts)])
    rows, digests = [], []
    for i, j in passes(offs):
        raw = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        own = offs[i : j + 1] - offs[i]
        starts, ends, first = word_bounds(raw, own, NOT_SPACE)
        if not len(starts):
            continue
        row = rows_of(first)
        h = PrefixHash(raw, powers)
        lines = np.concatenate([[0], np.cumsum(raw == 10)])
        opens = np.ones(len(starts), bool)
        opens[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] != lines[starts[:-1]]) | (h.of(starts, ends)[:-1] % np.uint64(PIECE_WORDS) == 0)
        at = np.flatnonzero(opens)
        rows.append(row[at] + i)
        digests.append(h.of(starts[at], ends[np.append(at[1:], len(starts)) - 1]))
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    row, digest = np.concatenate(rows), np.concatenate(digests)
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
    return digest[keep], np.searchsorted(row[keep], np.arange(len(texts) + 1))


def _places(keys: np.ndarray, third: np.ndarray) -> np.ndarray:
    return np.stack([(mix(keys + np.uint64(j + 1)) % third.astype(np.uint64)).astype(np.int64) + j * third for j in range(HASHES)])


def sketch(keys: np.ndarray, owner: np.ndarray, cells: np.ndarray, sign: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of all owners in one run of cells: offsets, counts, xor of keys, xor of checks."""
    offs = np.concatenate([[0], np.cumsum(cells)])
    count, total, check = np.zeros(offs[-1], np.int32), np.zeros(offs[-1], np.uint64), np.zeros(offs[-1], np.uint64)
    if len(keys):
        at = (_places(keys, cells[owner] // HASHES) + offs[owner]).ravel()
        np.add.at(count, at, np.tile(np.broadcast_to(sign, keys.shape), HASHES))
        np.bitwise_xor.at(total, at, np.tile(keys, HASHES))
        np.bitwise_xor.at(check, at, np.tile(mix(keys ^ np.uint64(0xC0FFEE)), HASHES))
    return offs, count, total, check


def peel(offs: np.ndarray, count: np.ndarray, total: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovers the digests of subtracted tables: (owner, digest, sign), and which owners came out whole."""
    cells, owner_of = np.diff(offs), np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    got_o, got_k, got_s = [], [], []
    while True:
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[check[pure] == mix(total[pure] ^ np.uint64(0xC0FFEE))]
        if not len(pure):
            break
        o, k, s = owner_of[pure], total[pure], count[pure]
        order = np.lexsort((k, o))
        o, k, s = o[order], k[order], s[order]
        keep = np.ones(len(o), bool)
        keep[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
        o, k, s = o[keep], k[keep], s[keep]
        got_o.append(o), got_k.append(k), got_s.append(s)
        at = (_places(k, cells[o] // HASHES) + offs[o]).ravel()
        np.subtract.at(count, at, np.tile(s, HASHES))
        np.bitwise_xor.at(total, at, np.tile(k, HASHES))
        np.bitwise_xor.at(check, at, np.tile(mix(k ^ np.uint64(0xC0FFEE)), HASHES))
    left = (count != 0) | (total != 0) | (check != 0)
    whole = np.ones(len(offs) - 1, bool)
    whole[owner_of[left]] = False
    if not got_o:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), whole
    return np.concatenate(got_o), np.concatenate(got_k), np.concatenate(got_s), whole


def differences(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (n x 2) of what the k-th set of a and of b have alone, from subtracted and peeled sketches; and the cells that took."""
    n = len(a_offs) - 1
    out, todo = np.zeros((n, 2), np.int64), np.arange(n)
    na, nb = np.diff(a_offs), np.diff(b_offs)
    size = np.full(n, cells)
    while len(todo):
        new = np.full(n, -1)
        new[todo] = np.arange(len(todo))
        oa, ob = np.repeat(new, na), np.repeat(new, nb)
        keys, owner = np.concatenate([a[oa >= 0], b[ob >= 0]]), np.concatenate([oa[oa >= 0], ob[ob >= 0]])
        sign = np.concatenate([np.ones((oa >= 0).sum(), np.int32), -np.ones((ob >= 0).sum(), np.int32)])
        o, _, s, whole = peel(*sketch(keys, owner, size[todo], sign))
        found = np.zeros((len(todo), 2), np.int64)
        np.add.at(found, (o, (s < 0).astype(np.int64)), 1)
        out[todo[whole]] = found[whole]
        todo = todo[~whole]
        every = ((na + nb) * 3 // 2 + HASHES) // HASHES * HASHES
        size[todo] = np.where(size[todo] == cells, np.maximum(every[todo], 2 * cells), 2 * size[todo])
    return out, size


def likeness(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared digests over all digests, and the cells that the difference took."""
    own, cells = differences(a, a_offs, b, b_offs)
    common = np.diff(a_offs) - own[:, 0]
    union = common + own.sum(axis=1)
    return np.where(union > 0, common / np.maximum(union, 1), 1.0), cells


def encode(digests: np.ndarray, offs: np.ndarray, cells: int = CELLS) -> list[str]:
    """The sketch of each set as text: number of digests, then the cells."""
    n = len(offs) - 1
    _, count, total, check = sketch(digests, rows_of(offs), np.full(n, cells))
    table = np.zeros((n, cells), CELL)
    table["c"], table["k"] = count.reshape(n, cells), total.reshape(n, cells)
    table["h"] = check.reshape(n, cells) & np.uint64(0xFFFF)
    return [f"{size}:{base64.b64encode(row.tobytes()).decode()}" for size, row in zip(np.diff(offs).tolist(), table)]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def decode(text: str) -> tuple[int, np.ndarray]:
    """Number of digests and the cells of an encoded sketch."""
    size, table = text.split(":")
    return int(size), np.frombuffer(base64.b64decode(table), CELL)


def _compare(rows: list[tuple[int, str, str]], powers: Powers) -> pa.RecordBatch:
    own = [t.encode() for _, t, _ in rows]
    changed = [_edited(t, f).encode() for _, t, f in rows]
    a, e, f = (piece_digests(x, powers) for x in (own, changed, [x[2].encode() for x in rows]))
    near_edited, near_next = likeness(*a, *e), likeness(*a, *f)
    columns = [[x[0] for x in rows], [len(x[1]) for x in rows], [hashlib.sha256(x).hexdigest() for x in changed], encode(*a), encode(*e), near_edited[0], near_next[0], near_edited[1], near_next[1]]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long"


def _kernel(batches):
    """Rows of one range of ids, ids descending; each row is compared with the one after it, the guests with none."""
    powers, held, rows, size = Powers(), None, [], 0
    for batch in batches:
        for part, doc, text, guest in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == part:
                rows.append((held[1], held[2], text))
                size += len(text) + len(held[2])
            held = None if guest else (part, doc, text)
            if size > 1 << 21:
                yield _compare(rows, powers)
                rows, size = [], 0
    if rows:
        yield _compare(rows, powers)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs, see SCHEMA. Texts are shuffled once, into ranges of ids; the first document of
    the next range is copied to the end of each range as a guest. The driver holds one id per range."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h"))
    n = max(4, 2 * shuffle_partitions(spark))
    cuts = sorted({int(x) for x in d.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) or []})
    part = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    d = d.withColumn("part", part)
    # Each range's first row is its largest id; of rows that share it, the one of largest text hash.
    heads = d.groupBy("part").agg(F.max(order).alias("head")).orderBy(F.col("part").desc()).collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    follow = {r["head"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    guest_of = [(r["head"]["i"], r["head"]["h"], follow[r["head"]]) for r in heads]
    guests = F.broadcast(spark.createDataFrame(guest_of, "gi long, gh long, host int"))  # one row per range
    o = d.withColumn("o", order)
    visiting = o.join(guests, (F.col("o.i") == F.col("gi")) & (F.col("o.h") == F.col("gh"))).dropDuplicates(["host"]).select(F.col("host").alias("part"), "doc_id", "text", F.lit(True).alias("guest"), "o")
    every = o.select("part", "doc_id", "text", F.lit(False).alias("guest"), "o").unionByName(visiting)
    dealt = every.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.col("o").desc())
    return dealt.select("part", "doc_id", "text", "guest").mapInArrow(_kernel, SCHEMA)
