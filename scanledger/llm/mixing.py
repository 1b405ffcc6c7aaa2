"""Mixing sources to target weights by systematic sampling (operator 5)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, numbered, packed, stored, unpacked, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20240131


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1); every rerun of a seed gets the same."""
    return random.Random(seed).random()


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for a table with one row per source (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``most`` times its source's
    size and the excess is shared again by weight until no target is above.
    Each turn is one aggregate over the sources; a full source stays full, so
    the turns end. A source of size 0 has target 0.
    """
    weight = F.lit(weights[-1])
    for place, value in enumerate(weights[:-1]):
        weight = F.when(F.col("_place") % len(weights) == place, value).otherwise(weight)
    placed = numbered(sizes, [F.col("source").isNull(), F.col("source")], "_place")
    ranked = stored(
        placed.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(most)).alias("most")),
        "sources",
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("weight") * level
        taken, left, now = ranked.agg(
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(is_full, True)),
        ).first()
        if now == full or not left:
            break
        level, full = (share * total - taken) / left, now
    target = F.least(F.col("most"), F.col("weight") * level) if level else F.lit(0.0)
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies, taken).

    A document is expected target / source_size times, the same for all
    documents of a source, so the prefix sum of expected copies after the k-th
    document is k times that rate. With one random offset added, a document is
    emitted once per integer boundary its stretch crosses: the floor or the
    ceiling of the rate. Documents are strung together by size (ties by
    doc_id), so what a source's words miss of its target is below its largest
    document. A source that holds most rows is numbered by range, not in one task.

    Null texts and texts of white space have size 0 and take 0 words. Null
    sources form one source; null ids sort first. Repeated rows count each.
    No rows give no rows. Extra columns are ignored.
    """
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    keys = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id")]
    placed = numbered(sized, keys, "_place")
    first = placed.groupBy("source").agg(F.min("_place").alias("_first"))
    sources = first.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source")))
    sources = sources.select(F.col("f.source").alias("_source"), "_first", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("_place") - F.col("_first")
    u = F.lit(offset(seed))
    crossed = F.floor((at + 1) * F.col("_rate") + u) - F.floor(at * F.col("_rate") + u)
    return (
        placed.join(sources, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("copies", crossed.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, whole and repeated as often as taken, with the columns given.

    Copies are looked up by doc_id, so texts are shuffled once, and not at all
    where the mix is small enough to be broadcast at run time. Rows that lack a
    doc_id or share one are looked up by their number in the order of doc_id,
    source and size, in which they and their copies are the same. Other columns
    may have any names.
    """
    mixed = stored(mix(docs, **settings).select("doc_id", "source", "size", "copies"), "mix")
    unclear = mixed.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").select(F.col("doc_id").alias("id"))
    whole = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=words(F.col("text")))

    def are(frame: DataFrame, how: str) -> DataFrame:
        return frame.join(unclear, F.col("doc_id").eqNullSafe(F.col("id")), how)

    taken = are(mixed, "left_anti").filter("copies > 0").select("doc_id", "copies")
    found = whole.select("row", "doc_id").join(taken, "doc_id").select("row", "copies")
    if not unclear.isEmpty():
        keys = lambda: [F.col(c).asc_nulls_last() for c in ("doc_id", "source", "size")] + [F.col("tie")]
        # The tie tells equal rows apart, so that many of them do not meet in one task.
        rows = numbered(are(whole, "left_semi").withColumn("tie", F.monotonically_increasing_id()), keys(), "place")
        counts = numbered(are(mixed, "left_semi").withColumn("tie", F.monotonically_increasing_id()), keys(), "place")
        alike = rows.select("row", "place").join(counts.filter("copies > 0").select("place", "copies"), "place")
        found = found.unionByName(alike.select("row", "copies"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return found.select("row", each).select(*unpacked(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def oracle() -> str:
    """The targets in closed form and the places by window; checks the turns and the numbering by range."""
    u = repr(offset())
    return f"""
    WITH d AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
        FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM d GROUP BY source
    ), r AS (
        SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER fuller, 0) AS taken,
               sum(weight) OVER () - coalesce(sum(weight) OVER fuller, 0) AS left_over, sum(source_size) OVER () * 1.5::DOUBLE AS total
        FROM s WINDOW fuller AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), l AS (
        SELECT (total - taken) / left_over AS level FROM r WHERE (total - taken) / left_over < 2.0::DOUBLE * source_size / weight
        ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST LIMIT 1
    ), t AS (
        SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM s, l
    ), p AS (
        SELECT d.doc_id, d.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
               row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), c AS (
        SELECT *, CAST(floor(place * rate + {u}::DOUBLE) - floor((place - 1) * rate + {u}::DOUBLE) AS BIGINT) AS copies FROM p
    )
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
    """
