"""Small tables that hold what real ones do: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("fp", "key", "size", "score", "label", "part", "words", "held_out", "lang_pred", "mixture", "component_id", "start", "path", "shard", "ids", "number", "candidate", "features", "digest", "licence", "_id", "_text")
PROSE = "the river rose over the old stone bridge and people of the town carried what they could up the hill before night came"
OTHER = "der fluss stieg über die alte brücke und die leute der stadt trugen alles was sie konnten den hügel hinauf bevor es nacht wurde"


def odd_rows() -> list[tuple]:
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate((PROSE + " ") .split() * 3000))
    return [
        (1, PROSE, "en", "a", len(PROSE)), (1, PROSE, "en", "a", len(PROSE)), (1, OTHER, "de", "b", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", None, "a", 4),
        (5, PROSE + " " + PROSE, "en", None, 9), (6, OTHER, "de", "b", 1), (7, "12345 !!! ...", "en", "b", 13), (None, PROSE, "en", "a", 7), (None, None, None, None, None), (8, long, "en", "a", len(long)),
        (9, "x" * 5000, "en", "a", 5000), (10, "naïve café 漢字 " * 20, "fr", "c", 5), (11, OTHER + " " + OTHER, "de", "b", 1), (12, PROSE.upper(), "en", "a", 1), (13, "a", "en", "a", 1), (-5, PROSE + " again", "en", "a", 2),
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA)


def with_clashes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def write(folder, docs: DataFrame, benchmark: DataFrame | None = None, labels: DataFrame | None = None) -> str:
    """A folder like those of the test data."""
    spark = docs.sparkSession
    benchmark = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string") if benchmark is None else benchmark
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (8, 0, 0), (None, 1, 1), (12, None, None), (10, 0, 1)], "doc_id long, quality int, toxic int") if labels is None else labels
    for name, df in (("documents", docs), ("benchmark", benchmark), ("labels", labels)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sorted_rows(df: DataFrame, columns=None) -> list[str]:
    return sorted(repr(tuple(r)) for r in (df.select(*columns) if columns else df).collect())
