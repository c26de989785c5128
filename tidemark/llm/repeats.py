"""Exact removal of repeated 100-byte strings.

A byte goes if some 100-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in
the same document. Strings stay inside a document and are judged on the input.

A difference cover samples positions so that any two suffixes have sampled positions at one common offset;
sampled ones are named and sorted, the rest is merged by them, neighbours are compared. Sorting two thirds
of all positions of a corpus cannot be afforded (README has figures), so the sample here is chosen by content:
in each 100-byte window the 32-byte string of least hash, its anchor. Equal windows have equal anchors at equal
offsets, so the sample covers as a difference cover does, with one position in 35.

1. Consecutive windows with one anchor form a segment. Segments are named by the hash of all bytes that their
   windows touch and sorted by (anchor, name, position). Of equal segments all but the first are removed windows.
   An anchor with a single name has no other repeats.
2. The first segments of anchors with several names are merged: their windows are sorted in groups of one
   anchor, neighbours are compared byte by byte, all but the first of equal ones are removed windows.
   Anchors with very many names send single windows instead, grouped by two hashes of the window, 128 bits together.
3. Removed windows are gathered by document and the text is cut.

Batches drop what they see to be repeats before each shuffle, so a passage in a third of all documents reaches
a task once per batch. Names of segments are 64-bit hashes beside their anchor's. Null and empty texts have no window; an empty
table gives an empty result. Of equal strings the first by doc_id, then start, stays. Very long texts are taken in tiles. A null doc_id counts as the
smallest. Rows that share a doc_id count as one document: what goes from one goes from the other, and a string
in both at one offset is one occurrence. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import PASS_BYTES, Powers, PrefixHash, cut, mix, passes, shuffle_partitions, text_buffer

LENGTH = 100
ANCHOR = 32
LOCAL_BITS = 21
#: Names of one anchor in a batch beyond which its windows are compared singly.
HOT_IN_BATCH = 64
#: Rows of one anchor that a task holds at once.
GROUP_ROWS = 200_000
NO_ID = -(1 << 63)
SEGMENT, APART, MARKER, REMOVED = 0, 1, 2, 3
#: Windows that the 24 bits of pack() hold.
MOST_WINDOWS = (1 << 24) - 1


def pack(kind, start, n):
    """Kind (2 bits), start (36 bits) and number of windows (24 bits) in one long that sorts by them."""
    return (np.asarray(kind, np.int64) << 60) | (np.asarray(start, np.int64) << 24) | np.asarray(n, np.int64)


def in_pieces(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut to at most MOST_WINDOWS windows, so that pack() can hold them."""
    count = -(-n // MOST_WINDOWS)
    run = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)) * MOST_WINDOWS
    return doc[run], start[run] + at, np.minimum(n[run] - at, MOST_WINDOWS)


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 60, (p >> 24) & ((1 << 36) - 1), p & ((1 << 24) - 1)


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    n = len(v) - w + 1
    whole = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(v)] = v
    table = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, offsets: np.ndarray, powers: Powers, length: int = LENGTH, anchor: int = ANCHOR):
    """Anchor hash, name, row, start in row and number of windows of all segments of one pass."""
    if len(raw) < length:
        return None
    p = PrefixHash(raw, powers)
    n = len(raw) - anchor + 1
    hashes = mix((p.sums[anchor:] - p.sums[:-anchor]) * powers.down[:n])
    place = np.uint64((1 << LOCAL_BITS) - 1)
    least = (window_minima((hashes & ~place) | np.arange(n, dtype=np.uint64), length - anchor + 1) & place).astype(np.int64)
    mark = np.zeros(len(least) + 2, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(mark, offsets[long], 1)
    np.subtract.at(mark, offsets[long + 1] - length + 1, 1)
    valid = np.cumsum(mark)[: len(least)] > 0
    opens = np.ones(len(least) + 1, bool)
    opens[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    opens[offsets[long]] = True
    edges = np.flatnonzero(opens)
    keep = valid[edges[:-1]]
    starts, count = edges[:-1][keep], np.diff(edges)[keep]
    names = p.of(starts, starts + count + length - 1)
    row = np.searchsorted(offsets, starts, "right") - 1
    return hashes[least[starts]].view(np.int64), names.view(np.int64), row, starts - offsets[row], count


def tiles(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Passes over whole rows; a row longer than a pass comes in tiles that share length - 1 bytes: (bytes, offsets, first row, start)."""
    for i, j in passes(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= PASS_BYTES:
            yield raw[a:b], offsets[i : j + 1] - a, i, 0
            continue
        for t in range(0, b - a - length + 1, PASS_BYTES):
            part = raw[a + t : min(b, a + t + PASS_BYTES + length - 1)]
            yield part, np.array([0, len(part)]), i, t


def merge_runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining runs of windows of one document as one."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + n[order]
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    reach = end.copy()
    for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
        reach[a:b] = np.maximum.accumulate(end[a:b])
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(opens)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1] - start[at]


def _later(first_of: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In sorted rows with runs opening at first_of: rows that lie after their run's first, and the run of each row."""
    run = np.cumsum(first_of) - 1
    at = np.flatnonzero(first_of)[run]
    return (doc != doc[at]) | (start != start[at]), run


ROWS = "key long, name long, doc long, packed long"


def _batch(key, name, doc, packed, names=("key", "name", "doc", "packed")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (key, name, doc, packed)], list(names))


def _route(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) ^ mix(start.astype(np.uint64))).view(np.int64)


def _name(batches):
    """Texts -> segments and what the batch alone shows to be removed."""
    powers = Powers()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        raw, offsets = text_buffer(batch.column(1))
        found = [(s, i, t) for part, offs, i, t in tiles(raw, offsets) if (s := segments(part, offs, powers)) is not None]
        if not found:
            continue
        key, name = (np.concatenate([s[k] for s, _, _ in found]) for k in (0, 1))
        doc = ids[np.concatenate([s[2] + i for s, i, _ in found])]
        start, n = np.concatenate([s[3] + t for s, _, t in found]), np.concatenate([s[4] for s, _, _ in found])
        order = np.lexsort((start, doc, name, key))
        key, name, doc, start, n = (x[order] for x in (key, name, doc, start, n))
        opens = np.ones(len(key), bool)
        opens[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        later, _ = _later(opens, doc, start)
        d, s, c = in_pieces(*merge_runs(doc[later], start[later], n[later]))
        yield _batch(_route(d, s), np.zeros(len(d)), d, pack(REMOVED, s, c))
        key, name, doc, start, n = (x[opens] for x in (key, name, doc, start, n))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(key)))
        hot = np.repeat(size > HOT_IN_BATCH, size)
        yield _batch(key[~hot], name[~hot], doc[~hot], pack(SEGMENT, start[~hot], n[~hot]))
        if hot.any():
            away = mix(key[hot].view(np.uint64) ^ mix(name[hot].view(np.uint64))).view(np.int64)
            yield _batch(away, name[hot], doc[hot], pack(APART, start[hot], n[hot]))
            marks = key[first][size > HOT_IN_BATCH]
            yield _batch(marks, np.full(len(marks), NO_ID), np.zeros(len(marks)), pack(np.full(len(marks), MARKER), 0, 0))


#: What the second step gets: removed runs (0), segments to merge by anchor (1), segments to take apart (2).
GONE, MERGE, SINGLE = 0, 1, 2
FOUND = "anchor long, doc long, start long, n long, kind int"


def _found(anchor, doc, start, n, kind) -> pa.RecordBatch:
    a = [np.asarray(x, np.int64) for x in (anchor, doc, start, n)]
    return pa.RecordBatch.from_arrays([*map(pa.array, a), pa.array(np.broadcast_to(np.asarray(kind, np.int32), a[1].shape).copy())], ["anchor", "doc", "start", "n", "kind"])


def _judge(key, name, doc, packed, forced: bool) -> list[pa.RecordBatch]:
    """Whole groups of equal keys, sorted."""
    kind, start, n = unpack(packed)
    out, gone = [], kind == REMOVED
    if gone.any():
        out.append(_found(key[gone], doc[gone], start[gone], n[gone], GONE))
    key, name, doc, start, n, kind = (x[~gone] for x in (key, name, doc, start, n, kind))
    if not len(key):
        return out
    opens = np.ones(len(key), bool)
    opens[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    later, _ = _later(opens, doc, start)
    mark = kind == MARKER
    later &= ~mark
    if later.any():
        out.append(_found(key[later], doc[later], start[later], n[later], GONE))
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    names = np.bincount(group, weights=opens & ~mark)
    hot = np.bincount(group, weights=mark | (kind == APART)) > 0
    if forced:
        hot[:] = True
    first = opens & ~mark
    single = first & hot[group]
    merge = first & ~hot[group] & (names[group] > 1)
    for which, k in ((single, SINGLE), (merge, MERGE)):
        if which.any():
            out.append(_found(key[which], doc[which], start[which], n[which], k))
    return out


def _sort_names(batches):
    """Rows sorted by key, name, doc, start. A key with over GROUP_ROWS rows is judged name by name as hot."""
    held, forced = None, None
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        held = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
        key, name = held[0], held[1]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            if forced is not None:
                own = int(np.searchsorted(key, forced, "right"))
                yield from _judge(*(x[:own] for x in held), forced=True)
                held, last, forced = [x[own:] for x in held], last - own, None
            if last:
                yield from _judge(*(x[:last] for x in held), forced=False)
            held = [x[last:] for x in held]
        if len(held[0]) > GROUP_ROWS:
            at = int(np.searchsorted(held[1], held[1][-1], "left"))
            if at:
                yield from _judge(*(x[:at] for x in held), forced=True)
                held, forced = [x[at:] for x in held], held[0][-1]
    if held is not None and len(held[0]):
        if forced is not None:
            own = int(np.searchsorted(held[0], forced, "right"))
            yield from _judge(*(x[:own] for x in held), forced=True)
            held = [x[own:] for x in held]
        if len(held[0]):
            yield from _judge(*held, forced=False)


PIECES = "key long, second long, doc long, start long, n long, piece binary"
#: Base of the second hash of single windows.
SECOND = np.uint64(0xD1342543DE82EF95)


def _pieces(key, second, doc, start, n, piece) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (key, second, doc, start, n)), pa.array(piece, pa.binary())], ["key", "second", "doc", "start", "n", "piece"])


def _expand(batches):
    """Texts with their open segments -> bytes of segments to merge, hashes of single windows. n is -1 for a removed window, 0 for a single one."""
    powers, others = Powers(), Powers(SECOND)
    for batch in batches:
        rows, single = [], []
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            for x in spans:
                n = min(x["n"], len(data) - LENGTH + 1 - x["start"])
                if n > 0:
                    part = data[x["start"] : x["start"] + n + LENGTH - 1]
                    if x["kind"] == MERGE:
                        rows.append((x["anchor"], 0, doc, x["start"], n, part))
                    else:
                        raw = np.frombuffer(part, np.uint8)
                        at = np.arange(n)
                        single.append((*(PrefixHash(raw, p).of(at, at + LENGTH).view(np.int64) for p in (powers, others)), np.full(n, doc), at + x["start"]))
        if rows:
            yield _pieces(*zip(*rows))
        if single:
            h, second, doc, start = (np.concatenate(x) for x in zip(*single))
            order = np.lexsort((start, doc, second, h))
            h, second, doc, start = h[order], second[order], doc[order], start[order]
            opens = np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])])
            later, _ = _later(opens, doc, start)
            yield _pieces(h[opens], second[opens], doc[opens], start[opens], np.zeros(opens.sum()), [None] * int(opens.sum()))
            d, s, c = merge_runs(doc[later], start[later], np.ones(later.sum(), np.int64))
            yield _pieces(_route(d, s), np.zeros(len(d)), d, s, -c, [None] * len(d))


def repeated_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows that equal an earlier one among the pieces: sorted by hash, neighbours compared by bytes."""
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    offs = np.concatenate([[0], np.cumsum(size)])
    count = size - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = offs[piece] + inside
    h = PrefixHash(raw, powers).of(at, at + LENGTH)
    d, s = doc[piece], start[piece] + inside
    order = np.lexsort((s, d, h))
    h, d, s, at = h[order], d[order], s[order], at[order]
    opens = np.ones(len(h), bool)
    opens[1:] = h[1:] != h[:-1]
    same = np.flatnonzero(~opens)
    for i in range(0, len(same), 1 << 15):
        x = same[i : i + (1 << 15)]
        span = np.arange(LENGTH)
        opens[x[(raw[at[x][:, None] + span] != raw[at[x - 1][:, None] + span]).any(axis=1)]] = True
    later, _ = _later(opens, d, s)
    return d[later], s[later]


def _merge(batches):
    """Pieces sorted by key, second, doc, start -> removed runs."""
    powers, held, size, first = Powers(), [], 0, None

    def done(rows):
        pieces = [r[4] for r in rows]
        d, s = repeated_windows(pieces, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), powers)
        d, s, n = merge_runs(d, s, np.ones(len(d), np.int64))
        return _found(np.zeros(len(d)), d, s, n, GONE)

    for batch in batches:
        key, second, doc, start, n = (c.to_numpy() for c in batch.columns[:5])
        gone = n < 0
        if gone.any():
            yield _found(key[gone], doc[gone], start[gone], -n[gone], GONE)
        one = np.flatnonzero(n == 0)
        if len(one):
            k, k2, d, s = key[one], second[one], doc[one], start[one]
            if first is not None and (k[0], k2[0]) == first[:2]:
                k, k2, d, s = (np.append(a, b) for a, b in zip(first, (k, k2, d, s)))
            opens = np.concatenate([[True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
            later, _ = _later(opens, d, s)
            yield _found(k[later], d[later], s[later], np.ones(later.sum()), GONE)
            lead = np.flatnonzero(opens)[-1]
            first = (k[lead], k2[lead], d[lead], s[lead])
        many = np.flatnonzero(n > 0)
        if len(many):
            for r in zip(key[many].tolist(), doc[many].tolist(), start[many].tolist(), n[many].tolist(), batch.column(5).take(pa.array(many)).to_pylist()):
                if held and size > PASS_BYTES and held[-1][0] != r[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
    if held:
        yield done(held)


def _cut_text(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            kept, at, removed, runs = [], 0, 0, 0
            reach = -1
            for x in sorted((x["start"], x["start"] + x["n"] - 1 + LENGTH) for x in spans or ()):
                a, b = x[0], min(x[1], len(data))
                if b <= a:
                    continue
                if a > reach:
                    kept.append(data[at:a])
                    runs += 1
                    removed += b - a
                    at = reach = b
                elif b > reach:
                    removed += b - reach
                    at = reach = b
            kept.append(data[at:])
            n_bytes.append(len(data)), n_removed.append(removed), n_spans.append(runs)
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _release(spark) -> None:
    """Lets Spark drop shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc, start, n: runs of n window starts whose windows are removed (they may overlap)."""
    spark = docs.sparkSession
    parts = max(12, shuffle_partitions(spark))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    named = d.mapInArrow(_name, ROWS).repartition(parts, "key").sortWithinPartitions("key", "name", "doc", "packed")
    found = cut(named.mapInArrow(_sort_names, FOUND))
    del named
    _release(spark)
    gone = found.filter(F.col("kind") == GONE).select("doc", "start", "n")
    spans = found.filter(F.col("kind") != GONE).groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n", "kind")).alias("spans"))
    pieces = d.join(spans, "doc").select("doc", "text", "spans").mapInArrow(_expand, PIECES)
    merged = cut(pieces.repartition(parts, "key").sortWithinPartitions("key", "second", "doc", "start").mapInArrow(_merge, FOUND).select("doc", "start", "n"))
    del pieces
    _release(spark)
    return gone.unionByName(merged)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of docs."""
    runs = removed_runs(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    d = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    return d.join(runs, "doc", "left").select("doc_id", "text", "runs").mapInArrow(_cut_text, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
