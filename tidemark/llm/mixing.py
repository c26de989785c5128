"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded selection.

A source is a party, its target the votes, a block of tokens a seat. Blocks go to sources by highest quotient
target / (2k + 1), then in the same way from each source to its shards, so every shard has an integer quota.
In a shard the documents lie in a seeded order as one run of tokens; the quota's whole passes take every
document once each, what is left takes the run's beginning. A source of n documents has about sqrt(n) shards
of sqrt(n) documents, so neither a shard nor the list of a source's shards outgrows a task.

Equal quotients go to the source of smaller rank, or the shard of smaller number; documents of a shard lie in order of a hash of
their id, then of id and size. Null and empty texts have size 0 and take 0; very long texts count like any. A null source is a source of its own, the last. Rows that share
a doc_id are rows of their own. An empty table gives an empty result. Other columns are ignored. SQL only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import heavy_keys, spread_join
from tidemark.llm.textkernel import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCKS = 1 << 20
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds rank, target and total to (source, source_size, n_docs): weights repeat by rank; what exceeds
    ``cap`` times a source's size is shared again by weight. One row per source, so one window holds them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sources.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("most", F.col("source_size") * float(cap)).withColumn("total", F.sum("source_size").over(every) * float(share))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / rest)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return s.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))).drop("weight", "most", "level")


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: seats (a column, equal in a group) given to the parties of each group by highest quotients.

    Rounding votes * seats / all misses the seats of a group of n by n / 2 at most, and moving the divisor to
    make that up moves a party by its share of n / 2 plus one. So only quotients that near to the rounded
    share are ranked, and the result is that of ranking all of them."""
    w = Window.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(w).cast("double")).withColumn("_n", F.sum((F.col(votes) > 0).cast("int")).over(w))
    p = p.withColumn("_ideal", F.when(F.col(votes) > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(0.0))
    p = p.withColumn("_half", (F.ceil(F.when(F.col(seats) > 0, F.col("_ideal") * F.col("_n") / (F.col(seats) * 2.0)).otherwise(0.0)) + 2).cast("long"))
    p = p.withColumn("_base", F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(F.col("_ideal") + 0.5) - F.col("_half"))).otherwise(0).cast("long"))
    p = p.withColumn("_open", F.col(seats) - F.sum("_base").over(w))
    seat = p.filter(F.col(votes) > 0).select(*group, party, votes, "_open", F.explode(F.expr("sequence(_base, _base + 2 * _half)")).alias("_k"))
    order = Window.partitionBy(*group).orderBy((F.col(votes) / (F.col("_k") * 2.0 + 1.0)).desc(), party, "_k")
    won = seat.withColumn("_place", F.row_number().over(order)).filter("_place <= _open").groupBy(*group, party).agg(F.count("*").alias("_won"))
    out = p.join(won, [*group, party], "left")
    return out.select(*parties.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: str = SEED, blocks: int = BLOCKS, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the row's source; one row per row of docs."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    name = F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col("source").cast("string"), F.lit("")))  # null is a source
    sized = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), key.alias("key"), name.alias("name")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = source_targets(sources, weights, share, cap).withColumn("block", F.greatest(F.lit(1), F.floor(F.col("total") / blocks)).cast("long"))
    s = s.withColumn("seats", F.floor(F.col("total") / F.col("block")).cast("long")).withColumn("g", F.lit(0))
    s = sainte_lague(s, ["g"], "rank", "target", "seats").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sqrt("n_docs"))).cast("long"))
    s = cut(s.select(name.alias("name"), "rank", "source_size", "target", "block", "shards", F.col("quota").alias("source_quota"), "n_docs"))
    dealt = spread_join(sized, s.drop("n_docs"), "name", heavy_keys(s, "name", "n_docs")).drop("name")
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shard = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shard = sainte_lague(shard, ["rank"], "shard", "shard_size", "source_quota").select("rank", "shard", "shard_size", "quota")
    run = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(shard, ["rank", "shard"]).withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    out = out.withColumn("words", F.least(F.col("quota") * F.col("block"), F.col("shard_size") * cap).cast("long"))
    out = out.withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0))
    part = F.greatest(F.lit(0), F.least("size", F.col("words") - F.col("passes") * F.col("shard_size") - F.col("before")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), "source")


def oracle(table: str = "documents", seed: str = SEED, blocks: int = BLOCKS) -> str:
    """The same result in DuckDB's SQL, with the quotients of every seat near the border ranked."""

    def lague(of: str, name: str, group: str, party: str, votes: str, seats: str) -> str:
        return f"""
{name}_a AS (SELECT *, sum({votes}) OVER (PARTITION BY {group})::DOUBLE AS all_, sum(({votes} > 0)::INT) OVER (PARTITION BY {group})::BIGINT AS n_ FROM {of}),
{name}_b AS (SELECT *, CASE WHEN {votes} > 0 THEN {votes} * {seats} / all_ ELSE 0 END AS ideal FROM {name}_a),
{name}_c AS (SELECT *, (ceil(CASE WHEN {seats} > 0 THEN ideal * n_ / ({seats} * 2.0::DOUBLE) ELSE 0 END) + 2)::BIGINT AS half FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN {votes} > 0 THEN greatest(0, floor(ideal + 0.5::DOUBLE)::BIGINT - half) ELSE 0 END AS base FROM {name}_c),
{name}_e AS (SELECT *, {seats} - sum(base) OVER (PARTITION BY {group}) AS open_ FROM {name}_d),
{name}_f AS (SELECT {group}, {party}, {votes}, open_, unnest(range(base, base + 2 * half + 1)) AS k FROM {name}_e WHERE {votes} > 0),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (k * 2.0::DOUBLE + 1) DESC, {party}, k) AS place FROM {name}_f),
{name}_h AS (SELECT {group}, {party}, count(*) AS won FROM {name}_g WHERE place <= open_ GROUP BY ALL),
{name} AS (SELECT e.* EXCLUDE (all_, n_, ideal, half, base, open_), (base + coalesce(won, 0))::BIGINT AS quota FROM {name}_e e LEFT JOIN {name}_h USING ({group}, {party}))"""

    return rf"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {table}),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
w AS (SELECT *, ([5, 2, 1])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT min(level) AS level FROM (SELECT level, row_number() OVER (ORDER BY most / weight, rank) AS i FROM l WHERE level <= most / weight QUALIFY i = 1)),
t AS (SELECT source, source_size, n_docs, rank, total, coalesce(least(most, lv.level * weight), most) AS target, greatest(1, floor(total / {blocks})::BIGINT) AS block, 0 AS g FROM l, lv),
t2 AS (SELECT *, floor(total / block)::BIGINT AS seats FROM t),{lague("t2", "sq", "g", "rank", "target", "seats")},
s AS (SELECT source AS name, rank, source_size, target, block, greatest(1, ceil(sqrt(n_docs::DOUBLE))::BIGINT) AS shards, quota AS source_quota FROM sq),
dealt AS (SELECT sized.*, s.* EXCLUDE (name), ('0x' || key[1:8])::BIGINT % shards AS shard FROM sized JOIN s ON source IS NOT DISTINCT FROM name),
sh AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota FROM dealt GROUP BY rank, shard),{lague("sh", "hq", "rank", "shard", "shard_size", "source_quota")},
o AS (SELECT dealt.*, shard_size, coalesce(sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef, least(quota * block, shard_size * 2) AS words FROM dealt JOIN hq USING (rank, shard)),
p AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes FROM o)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * shard_size - bef)))::BIGINT AS taken, source FROM p"""
