"""Every query over odd tables, empty ones and ones with more columns: as many rows as stated, and the same results."""

import pytest

import corpus_pipeline
from tests.llm.test_brute_force import _components, _simhash
from tests.llm.fixtures import SCHEMA, odd_docs, odd_rows, sorted_rows, with_clashes, write
from tidemark.llm.queries import queries

QUERIES = queries()
#: Queries that give a row per row of documents.
PER_ROW = [n for n in QUERIES if not n.startswith(("op3_", "op9_"))]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    docs = odd_docs(spark)
    return {"odd": write(root / "odd", docs), "more": write(root / "more", with_clashes(docs)), "none": write(root / "none", spark.createDataFrame([], SCHEMA))}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folders, name):
    first = QUERIES[name](spark, folders["odd"])
    rows = sorted_rows(first)
    if name in PER_ROW:
        assert len(rows) == len(odd_rows())
    again = QUERIES[name](spark, folders["more"])
    assert again.columns == first.columns
    assert sorted_rows(again) == rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    out = QUERIES[name](spark, folders["none"])
    assert out.columns == QUERIES[name](spark, folders["odd"]).columns
    assert out.collect() == []


@pytest.mark.parametrize("which", ["odd", "more", "none"])
def test_stages(spark, folders, which, tmp_path):
    docs = spark.read.parquet(f"{folders[which]}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folders[which])
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / name))
        assert docs.count() <= before
        if name in ("secret_scan", "mix"):
            assert docs.count() == before


def test_stage_decisions(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, docs, folders["odd"])
    rows = [(r[0], r[1]) for r in odd_rows()]
    group = _components({k: _simhash(t or "") for k, (_, t) in enumerate(rows)})
    best = {}
    for k, (d, t) in enumerate(rows):  # the smallest id stays, none only where there is no other
        best[group[k]] = min(best.get(group[k], (True, 0, "")) if group[k] in best else (d is None, d or 0, t or ""), (d is None, d or 0, t or ""))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()]
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in best.values())
    assert sorted(_simhash(x[2]) for x in got if not x[0]) == sorted(_simhash(x[2]) for x in best.values() if not x[0])
    clean = stages["decontaminate"](spark, docs, folders["odd"])
    left = {(r["doc_id"], r["text"] == "") for r in clean.collect()}
    assert not {(5, False), (12, False), (-5, False)} & left and {(6, False), (3, True), (8, False)} <= left
    assert all(r["doc_id"] is not None or r["text"] is None for r in clean.collect())


def test_run_is_the_stages_in_turn(spark, folders):
    out = corpus_pipeline.run(spark, folders["odd"])
    assert {"doc_id", "taken"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "secret_scan", "mix"]


def test_language_stage_keeps_mixed_texts(spark, tmp_path):
    """Three learnt languages in one text stay; a script that none of them has goes."""
    import random

    random.seed(2)
    words = {"aa": ["baba", "kaba", "labaka", "makaba"], "bb": ["tirix", "sixit", "zitrix", "pix"], "cc": ["uolo", "ouel", "luoe", "oelou"]}
    say = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    rows = [(k, say(lang, 80), lang, "s", 1) for k, lang in enumerate(["aa", "bb", "cc"] * 15)]
    rows += [(100, " ".join((say("aa", 80), say("bb", 70), say("cc", 60))), None, "s", 1), (101, "съешь ещё этих мягких французских булок да выпей чаю " * 5, None, "s", 1), (102, "1234 !!!", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {101, 102}


def test_run_leaves_one_table(spark, folders):
    import pathlib

    from tidemark.llm.textkernel import ensure_checkpoint_dir

    root = pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("tables-*"))
    corpus_pipeline.run(spark, folders["odd"])
    assert len(set(root.glob("tables-*")) - before) == 1
