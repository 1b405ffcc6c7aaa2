"""The prefix trie of conversations by bursting containers (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, load, stored

CONTAINER_TURNS = 1 << 11  # turns in a container of several conversations that is swept as it is
LIST_BYTES = 1 << 16  # of a list of members hashed piece by piece

NO_ENDS = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<id:binary,size:long>>"
ROOT = b""  # the head of the whole trie


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that tell turns apart by role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (id, code points) in order; null turn numbers first, ties by turn id.

    A null role or text is empty. Rows without conv_id belong to no
    conversation. Extra columns are left out. Texts are hashed before the
    shuffle, so memory follows the number of turns of the longest conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"), F.length(text).cast("long").alias("size")).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"], t["size"])).cast(TURNS).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """The conversations of the contract: each begins with up to five turns of the first one of its hundred."""
    c = F.col("conv_id")
    heads = lists.select(c.alias("base"), F.slice("turns", 1, 5).alias("base_turns"))
    h = (F.crc32(c.cast("string")) % 6).cast("int")
    joined = lists.select("conv_id", "turns", (c - c % 100).alias("base"), h.alias("h")).join(heads, "base", "left")
    none = F.array().cast(TURNS)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("base_turns", none), F.lit(1), F.col("h")), rest).alias("turns"))


def _common(low: Column, high: Column) -> Column:
    """How many turns the least and the greatest of sorted lists, and so all between them, begin with alike."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
    return F.when(differs < 0, F.least(F.size(low), F.size(high))).otherwise(differs)


def _next_head(head: Column, turns: Column) -> Column:
    return F.unhex(F.md5(F.concat(head, F.get(turns, F.lit(0))["id"])))


NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ending long, path array<binary>"


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose conversations come sorted; the first node of a container also names its trie heads.

    Holds the nodes of one container at a time.
    """
    head, sizes, ids = None, [], []
    nodes: list[dict] = []
    open_nodes: list[int] = []

    def close(depth: int) -> None:
        while len(open_nodes) > depth:
            node = nodes[open_nodes.pop()]
            node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("size")
            node["n_leaves"] = node["n_leaves"] or 1
            if open_nodes:
                above = nodes[open_nodes[-1]]
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
                above["n_convs"] += node["n_convs"]
                above["conv_id"] = min(above["conv_id"], node["conv_id"])

    def finished() -> pa.RecordBatch:
        close(0)
        for node in nodes:
            above = node.pop("above")
            node["parent_conv_id"] = None if above is None else nodes[above]["conv_id"]
        names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ending"]
        arrays = [pa.array([node[name] for node in nodes], pa.int64()) for name in names]
        paths = pa.array([node["path"] for node in nodes], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([*arrays, paths], [*names, "path"])

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("head", "path", "base", "conv_id", "n", "turns")]
        for new_head, path, base, conv, n, turns in zip(*columns, strict=True):
            if new_head != head:
                if nodes:
                    yield finished()
                head, nodes, open_nodes, ids = new_head, [], [], []
            sizes = [turn["size"] for turn in turns]
            new = [turn["id"] for turn in turns]
            same = 0
            while same < min(len(ids), len(new)) and ids[same] == new[same]:
                same += 1
            close(same)
            ids = new
            for depth in range(same, len(ids)):
                above = open_nodes[-1] if open_nodes else None
                open_nodes.append(len(nodes))
                nodes.append(
                    {
                        "depth": base + depth + 1,
                        "conv_id": conv,
                        "above": above,
                        "n_convs": 0,
                        "n_children": 0,
                        "n_leaves": 0,
                        "saved_tokens": 0,
                        "size": sizes[depth],
                        "ending": None,
                        "path": path if above is None else None,
                    }
                )
            # Copies are one record and no list is empty, so the last open node is new or was a prefix that ended before.
            last = nodes[open_nodes[-1]]
            last["n_convs"] += n
            last["conv_id"] = min(last["conv_id"], conv)
            last["ending"] = conv
    if nodes:
        yield finished()


def endings(lists: DataFrame) -> DataFrame:
    """(ending, ends_sha256): per group of equal conversations, named by its smallest id, the digest of all its ids.

    Ids are sorted by range over all tasks and written out as pieces of lists;
    only the pieces of a group meet, one after the other, in the task that
    hashes them, so a group of any size needs no memory.
    """
    key = [F.xxhash64("turns").alias("k1"), F.xxhash64(F.lit(1), "turns").alias("k2")]
    members = lists.select(*key, "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "first", "piece"])

        for batch in batches:
            found, last = [], None
            for k1, k2, conv in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (k1, k2) != last or held > LIST_BYTES:  # noqa: F821
                    last, held = (k1, k2), 0
                    found.append((k1, k2, conv, []))
                found[-1][3].append(str(conv))
                held += len(found[-1][3][-1]) + 1
            if found:
                yield rows([(k1, k2, first, ",".join(ids)) for k1, k2, first, ids in found])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first_id, digest = None, None, None
        for batch in batches:
            done = []
            for k1, k2, first, piece in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if (k1, k2) != last:
                    if last:
                        done.append((first_id, digest.hexdigest()))
                    last, first_id, digest = (k1, k2), first, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["ending", "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([first_id], pa.int64()), pa.array([digest.hexdigest()])], ["ending", "ends_sha256"])

    listed = members.mapInArrow(pieces, "k1 long, k2 long, first long, piece string")
    return listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "ending long, ends_sha256 string")


def prefix_trie(lists: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The trie of all conversations (conv_id, turns): one row per node.

    conv_id (smallest member), depth, parent_conv_id (of the root null),
    n_convs, n_children, n_leaves and saved_tokens of the subtree, and
    ``ending``, the smallest of the members that end there (null if none);
    conversations without turns end at the root. No conversations, no nodes.

    Copies are counted and stand for one another first. The others lie in
    containers of suffixes, at the start one per first turn. A container of
    several conversations and more than ``container_turns`` turns bursts: what
    all of them begin with becomes nodes, and the next turn ids are the heads of
    new containers. Each round moves the rows of oversized containers only.
    The remaining containers are dealt by head, sorted and swept; so a task
    holds the nodes of one container or of one conversation.
    """
    records = stored(lists.groupBy("turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "trie-records")
    turnless = records.filter(F.size("turns") == 0).select(F.col("conv_id").alias("ending"))
    active = records.filter(F.size("turns") > 0).select(
        _next_head(F.lit(ROOT), F.col("turns")).alias("head"), F.array(F.lit(ROOT)).alias("path"), F.lit(0).cast("long").alias("base"), "conv_id", "n", "turns"
    )
    settled, bursts, ended = [], [], []
    while True:
        held = active.groupBy("head").agg(
            F.count("*").alias("lists"),
            F.sum(F.size("turns")).alias("held"),
            F.sum("n").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.min("turns").alias("low"),
            F.max("turns").alias("high"),
            F.min("path").alias("path"),
            F.min("base").alias("base"),
        )
        over = held.filter((F.col("lists") > 1) & (F.col("held") > container_turns))
        over = stored(over.withColumn("common", _common(F.col("low"), F.col("high"))), "trie-bursts")
        if over.isEmpty():
            settled.append(active)
            break
        bursts.append(over.select("head", "path", "base", "conv_id", "n_convs", F.slice("low", F.lit(1), F.col("common"))["size"].alias("sizes")))
        settled.append(stored(active.join(over.select("head"), "head", "left_anti"), "trie-settled"))
        moved = active.join(over.select("head", "common"), "head")
        ended.append(moved.filter(F.size("turns") == F.col("common")).select("head", F.col("conv_id").alias("ending")))
        left = F.slice("turns", F.col("common") + 1, F.size("turns"))
        active = moved.filter(F.size("turns") > F.col("common")).select(
            _next_head(F.col("head"), left).alias("head"),
            F.concat("path", F.array("head")).alias("path"),
            (F.col("base") + F.col("common")).alias("base"),
            "conv_id",
            "n",
            left.alias("turns"),
        )
        active = stored(active, "trie-active")

    def union(frames: list[DataFrame]) -> DataFrame:
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    dealt = union([frame.select("head", "path", "base", "conv_id", "n", "turns") for frame in settled]).repartition("head")
    swept = stored(dealt.sortWithinPartitions("head", "turns").mapInArrow(_sweep, NODE), "trie-nodes")
    everyone = records.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")).filter("n_convs IS NOT NULL")
    top = everyone.select(F.lit(ROOT).alias("head"), F.array().cast("array<binary>").alias("path"), F.lit(0).cast("long").alias("base"), "conv_id", "n_convs", F.array().cast("array<long>").alias("sizes"))
    heads = stored(union([top, *bursts]), "trie-heads")
    last_words = turnless.select(F.lit(ROOT).alias("head"), "ending")
    last_words = union([last_words, *ended])

    # What lies below each trie head: all it is on the path of.
    chain = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    below = swept.filter("path IS NOT NULL").select("path", "n_leaves", "saved_tokens")
    below = below.unionByName(heads.filter(F.size("path") > 0).select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * chain).alias("saved_tokens")))
    parts = below.select(F.posexplode("path").alias("at", "head"), F.size("path").alias("deep"), "n_leaves", "saved_tokens")
    totals = parts.groupBy("head").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_below"), F.count_if(F.col("at") == F.col("deep") - 1).alias("n_children")
    )
    parents = heads.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = heads.join(totals, "head", "left").join(last_words, "head", "left").withColumn("parent", F.get("path", F.size("path") - 1)).join(parents, "parent", "left")
    full = full.select(
        "base", "conv_id", "parent_conv_id", "n_convs", "ending", "sizes",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_below", F.lit(0)).alias("saved_below"),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ending"]
    root = full.filter("base = 0 AND parent_conv_id IS NULL").select(
        "conv_id", F.col("base").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_below").alias("saved_tokens"), "ending"
    )
    links = full.select("*", F.posexplode("sizes").alias("at", "size"))
    is_last = F.col("at") == F.size("sizes") - 1
    rest = F.aggregate(F.slice("sizes", F.col("at") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, b: a + b)
    links = links.select(
        "conv_id",
        (F.col("base") + F.col("at") + 1).alias("depth"),
        F.when(F.col("at") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(is_last, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("saved_below") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(is_last, F.col("ending")).alias("ending"),
    )
    tops = swept.filter("path IS NOT NULL").drop("parent_conv_id").withColumn("parent", F.get("path", F.size("path") - 1)).join(parents, "parent")
    inner = swept.filter("path IS NULL").select(*columns)
    return root.unionByName(links).unionByName(tops.select(*columns)).unionByName(inner)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stored(rebuilt(sequences(load(spark, sf_dir, "conversations"))), "conversations")
    nodes = prefix_trie(lists).join(endings(lists), "ending", "left")
    counts = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select("conv_id", *[F.col(c).cast("long").alias(c) for c in counts], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def oracle() -> str:
    """Every prefix of every conversation as a row, grouped."""
    return f"""
    WITH t AS (
        SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS i
        FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                     length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)
    ), c AS (
        SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
    ), r AS (
        SELECT c.conv_id, 0 AS part, i, id, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE i < h
        UNION ALL
        SELECT c.conv_id, 1, i, id, size FROM c JOIN t ON t.conv_id = c.conv_id WHERE i >= h
    ), s AS (
        SELECT c.conv_id, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes FROM c LEFT JOIN (
            SELECT conv_id, list(id ORDER BY part, i) AS ids, list(size ORDER BY part, i) AS sizes FROM r GROUP BY conv_id) USING (conv_id)
    ), p AS (
        SELECT conv_id, d, md5(array_to_string(ids[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], '')) END AS above,
               CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(ids) AS is_end
        FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM s)
    ), n AS (
        SELECT d, node, any_value(above) AS above, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
        FROM p GROUP BY d, node
    ), k AS (
        SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, above
    ), f AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.node = k.node
    ), sums AS (
        SELECT a.d, a.node, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved
        FROM f JOIN p a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.d, a.node
    )
    SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, sums.n_leaves::BIGINT AS n_leaves,
           sums.saved::BIGINT AS saved_tokens, f.ends_sha256
    FROM f JOIN sums ON f.d = sums.d AND f.node = sums.node LEFT JOIN n u ON u.d = f.d - 1 AND u.node = f.above
    """
