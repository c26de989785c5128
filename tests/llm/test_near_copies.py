"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.fixtures import SCHEMA
from tidemark.llm import nearcopies


def _sets(text, n=5):
    low = (text or "").encode().lower().split()
    return {b" ".join(low[i : i + n]) for i in range(max(1, len(low) - n + 1))}


def _kept(texts):
    """doc_ids that stay, by comparing all pairs that have a shingle in common."""
    sets, parent = [_sets(t) for t in texts], list(range(len(texts)))
    holders = {}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders.get(x, ()))
        for j, both in shared.items():
            if both * 5 >= (len(s) + len(sets[j]) - both) * 4:
                a, b = sorted((root(k), root(j)))
                parent[b] = a
        for x in s:
            holders.setdefault(x, []).append(k)
    return {root(k) for k in range(len(texts))}


def _changed(words, n):
    words = list(words)
    for k in random.sample(range(len(words)), n):
        words[k] = f"z{random.randrange(10**9)}"
    return words


def _texts():
    random.seed(12)
    out = ["", None, " ", "one two", "One  TWO", "one two three"]
    for n in (0, 1, 2, 3, 4, 5, 6, 8):
        for _ in range(12):
            base = [f"w{random.randrange(5000)}" for _ in range(200)]
            out += [" ".join(base), " ".join(_changed(base, n))]
    for spread in (1, 2, 3):  # crowds: close, mixed and mostly under the limit
        base = [f"w{random.randrange(5000)}" for _ in range(200)]
        out += [" ".join(_changed(base, random.randrange(spread, 2 * spread + 1))) for _ in range(60)]
    common = [f"c{k}" for k in range(150)]  # a passage that makes up most of texts that are no copies
    out += [" ".join(common + [f"w{random.randrange(5000)}" for _ in range(60)]) for _ in range(40)]
    random.shuffle(out)
    return out


@pytest.mark.parametrize("limit, block", [(nearcopies.PAIRS_OF, nearcopies.BLOCK_NODES), (3, 20)])
def test_all_near_copies_go(spark, limit, block):
    texts = _texts()
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    got = [r["doc_id"] for r in nearcopies.keep_one(docs, limit, block).collect()]
    assert len(got) == len(set(got)) and set(got) == _kept(texts)


def test_stage_on_the_table(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[k][0] for k in _kept([t for _, t in rows])}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, folder).collect()} == want


def test_across_links_every_pair_of_labels():
    sets = [np.sort(np.array(s, np.uint64)) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6], [9], [9, 10], [1, 2, 3, 4])]
    assert {tuple(sorted(p)) for p in nearcopies.across(np.array([0, 0, 1, 2, 3, 4]), sets)} == {(1, 2), (0, 5), (2, 5)}


def _bits(text, n=5):
    """SimHash of the set of shingles, bit by bit."""
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in _sets(text, n)]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def _connected(n, linked):
    label = list(range(n))
    for j in range(n):
        for i in range(j):
            if label[i] != label[j] and linked(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_fingerprints_of_whole_sets():
    long = " ".join(f"v{k}" for k in range(70_000))
    for text in ("a", "a b c", "a b c d e f", "a b c d e f g", "x " * 50, long):
        assert nearcopies.fingerprint(nearcopies.shingles(text.strip().encode())) % 2**64 == _bits(text)


@pytest.mark.parametrize("limit, block", [(nearcopies.PAIRS_OF, nearcopies.BLOCK_NODES), (3, 20)])
def test_golay_keys_find_all_close_copies(spark, monkeypatch, limit, block):
    """Where no two texts share a band, those of similarity 0.8 within four bits are still linked, and only these."""

    signed = nearcopies.signed

    def bands_of_its_own(docs, keep):
        alone = F.unhex(F.lpad(F.hex("node"), 16, "0"))
        return signed(docs, keep).withColumn("bands", F.when(F.length("bands") > 0, alone).otherwise(F.col("bands")))

    random.seed(3)
    texts = ["", None]
    for n in (1, 1, 2, 3):
        for _ in range(10):
            base = [f"w{random.randrange(5000)}" for _ in range(200)]
            texts += [" ".join(base), " ".join(_changed(base, n))]
    base = [f"w{random.randrange(5000)}" for _ in range(1500)]
    texts += [" ".join(_changed(base, random.randrange(1, 9))) for _ in range(60)]  # a crowd
    sets, fps = [_sets(t) for t in texts], [_bits(t) if t else 0 for t in texts]
    group = _connected(len(texts), lambda i, j: texts[i] and texts[j] and (fps[i] ^ fps[j]).bit_count() <= 4)
    label = _connected(len(texts), lambda i, j: group[i] == group[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4)
    monkeypatch.setattr(nearcopies, "signed", bands_of_its_own)
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    got = [r["doc_id"] for r in nearcopies.keep_one(docs, limit, block).collect()]
    assert len(set(label)) < len(texts) - 60 and sorted(got) == sorted(set(label) - {1})  # null and empty are one
