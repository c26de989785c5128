"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased runs of letters, digits and non-ASCII bytes; documents and items are lower-cased by one
function. An item of m words is looked for in windows of m words (the whole text where it is shorter). A window of similarity
``SIMILARITY`` shares all but few of the item's five-word shingles, so it shares one of the item's rarest few, its gates:
an item whose gates a text lacks is in none of its windows, and a shingle that many items have opens
few. Windows are laid at every alignment that a shingle shared with an item behind an open gate gives. Each window's
SimHash is looked up among the items' in eight blocks of eight bits: of at
most ``RADIUS`` differing bits some block has two or fewer, so probing every block value within two bits misses
none. Candidates are verified by the weighted (multiset) Jaccard similarity of their shingles.

Result: a row per document and item found, with its best window. Null and empty texts and items have no
window. Ties of similarity go to the first window. Repeated rows and ids are rows of their own; an empty table or
an empty benchmark finds nothing. Very long texts are searched whole, a text at a time. Other columns are ignored.

The benchmark is taken in slices of ``SLICE_BYTES`` of text, the bound of what is collected and broadcast at a time; each
slice is a pass over the documents of its own, stored before the next slice is read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import Powers, PrefixHash, cut, mix, passes, text_buffer, word_bounds

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 3 * BLOCKS - 1
#: Bytes of benchmark text that one pass over the documents takes; a larger benchmark takes several passes.
SLICE_BYTES = 16 << 20

MASKS = np.array([m for m in range(256) if m.bit_count() <= 2])


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ones reach into the next row."""
    total = np.zeros(len(words), np.uint64)
    for i in range(size):
        total[: len(words) - i] = total[: len(words) - i] * np.uint64(0x100000001B3) + words[i:]
        total[len(words) - i :] = 0
    return mix(total)


def own_shingles(words: np.ndarray) -> np.ndarray:
    """Shingles of one word sequence, a single one if it is short."""
    size = min(SHINGLE, len(words))
    return shingle_hashes(words, size)[: len(words) - size + 1]


def simhash(shingles: np.ndarray) -> np.uint64:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).view(np.uint64)[0]


class Items:
    """Shingle index and SimHash block tables of one slice of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float) -> None:
        powers, self.ids, self.words, self.bags, self.offsets, prints = Powers(), [], [], [], [], []
        for item, text in rows:
            raw = np.frombuffer(lowered(text), np.uint8)
            starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
            if not len(starts):
                continue
            s = own_shingles(PrefixHash(raw, powers).of(starts, ends))
            where: dict[int, list[int]] = {}
            for offset, h in enumerate(s.tolist()):
                where.setdefault(h, []).append(offset)
            self.offsets.append(where)
            self.ids.append(item), self.words.append(len(starts)), self.bags.append(Counter(s.tolist())), prints.append(simhash(s))
        common = Counter(h for where in self.offsets for h in where)
        self.gates: dict[int, list[int]] = {}
        for k, bag in enumerate(self.bags):
            missing = bag.total() - math.ceil(similarity * bag.total() - 1e-9)  # so many shingles, at most, a similar window lacks
            for h in sorted(bag, key=lambda h: (common[h], h)):
                self.gates.setdefault(h, []).append(k)
                missing -= bag[h]
                if missing < 0:
                    break
        self.short = sorted({n for n in self.words if n < SHINGLE})
        self.hashes = np.sort(np.array(list(common), np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.array(prints, np.uint64)
        own = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        self.tables = [[np.flatnonzero(own[:, b] == v) for v in range(256)] for b in range(BLOCKS)]

    def occurs(self, h: np.ndarray) -> np.ndarray:
        """Positions whose hash is a shingle of an item."""
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == h[at]]

    def near(self, window: np.uint64) -> np.ndarray:
        """Items within RADIUS of a window's SimHash."""
        parts = np.array([window], np.uint64).view(np.uint8)
        found = np.unique(np.concatenate([self.tables[b][v] for b in range(BLOCKS) for v in (int(parts[b]) ^ MASKS).tolist()]))
        return found[np.bitwise_count(self.prints[found] ^ window) <= RADIUS]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return shared / (a.total() + b.total() - shared)


def search(raw: np.ndarray, offsets: np.ndarray, items: Items, powers: Powers, similarity: float):
    """(row, item number, similarity, first word, words) of one pass."""
    starts, ends, first = word_bounds(raw, offsets)
    if not len(starts) or not len(items.hashes):
        return
    words = PrefixHash(raw, powers).of(starts, ends)
    hits = []
    for size in (SHINGLE, *items.short):
        h = shingle_hashes(words, size)
        at = items.occurs(h)
        row = np.searchsorted(first, at, "right") - 1
        whole = at + size <= first[row + 1]
        hits += [(int(p), int(r), int(x)) for p, r, x in zip(at[whole], row[whole], h[at[whole]])]
    by_row: dict[int, list[tuple[int, int]]] = {}
    for p, row, h in hits:
        by_row.setdefault(row, []).append((p, h))
    windows: dict[int, set[tuple[int, int]]] = {}
    for row, own in by_row.items():
        lo, hi = int(first[row]), int(first[row + 1])
        for item in {k for _, h in own for k in items.gates.get(h, ())}:
            m, offsets = min(items.words[item], hi - lo), items.offsets[item]
            windows.setdefault(row, set()).update((min(max(p - offset, lo), hi - m), m) for p, h in own for offset in offsets.get(h, ()))
    for row, found in windows.items():
        best: dict[int, tuple[float, int, int]] = {}
        for start, m in sorted(found):
            own = own_shingles(words[start : start + m])
            bag = None
            for item in items.near(simhash(own)).tolist():
                if min(items.words[item], int(first[row + 1] - first[row])) != m:
                    continue
                bag = bag or Counter(own.tolist())
                s = weighted_jaccard(bag, items.bags[item])
                if s >= similarity and s > best.get(item, (0.0,))[0]:
                    best[item] = (s, start - int(first[row]), m)
        for item, (s, start, m) in best.items():
            yield row, item, s, start, m


def _slices(benchmark: DataFrame, slice_bytes: int):
    """The benchmark's items, about ``slice_bytes`` of text at a time, broadcast; and whether there is more than one slice.

    A slice leaves the driver and the executors before the next one comes."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    slices = int(size // slice_bytes) + 1
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    for k in range(slices):
        shared = spark.sparkContext.broadcast({"rows": [(r["item_id"], r["text"]) for r in items.filter(number == k).collect()]})
        yield shared, slices > 1
        if slices > 1:
            shared.destroy()


def _items(shared, similarity: float) -> Items:
    """Made once in a worker, which keeps the broadcast value."""
    held = shared.value
    if "items" not in held:
        held["items"] = Items(held["rows"], similarity)
    return held["items"]


def _hits(texts: pa.Array, items: Items, powers: Powers, similarity: float):
    """(row, item number, similarity, first word, words) of a whole column."""
    raw, offsets = text_buffer(pa.array([lowered(t.as_py()) for t in texts], pa.large_binary()))
    for i, j in passes(offsets):
        for row, *hit in search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], items, powers, similarity):
            yield i + row, *hit


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words."""
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"

    def against(shared) -> DataFrame:
        def kernel(batches):
            items, powers = _items(shared, similarity), Powers()
            for batch in batches:
                doc = batch.column(0)
                out = [(doc[row].as_py(), items.ids[item], s, start, m) for row, item, s, start, m in _hits(batch.column(1), items, powers, similarity)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, schema)

    out = None
    for shared, several in _slices(benchmark, slice_bytes):
        one = cut(against(shared)) if several else against(shared)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without the rows that hold an item; same columns. Rows are judged one by one, so no text is shuffled and no id is needed."""

    def without(rows: DataFrame, shared) -> DataFrame:
        at = rows.columns.index("text")

        def kernel(batches):
            items, powers = _items(shared, similarity), Powers()
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in _hits(batch.column(at), items, powers, similarity)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(kernel, rows.schema)

    for shared, several in _slices(benchmark, slice_bytes):
        docs = cut(without(docs, shared)) if several else without(docs, shared)
    return docs
