"""A repeated run longer than one packed row can hold."""

import hashlib

from tests.llm.fixtures import SCHEMA
from tidemark.llm import repeats


def test_a_repeated_text_over_16_mib(spark):
    head = "".join(f"{k:05d}" for k in range(30))
    text = head + "a" * 20_000_000
    docs = spark.createDataFrame([(1, text, None, None, 0)], SCHEMA)
    got = repeats.remove_repeats(docs).first()
    # windows of 'a' alone repeat from the second on: its bytes but the first go
    kept = (head + "a").encode()
    assert (got["n_bytes"], got["n_removed"], got["n_spans"]) == (len(text), len(text) - len(kept), 1)
    assert got["kept_sha256"] == hashlib.sha256(kept).hexdigest()
