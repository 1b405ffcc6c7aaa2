"""Approximate nearest neighbours on robust-pruned directed graphs (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored
from .vectors import lengths, matrix, taking_part

NEIGHBOURS = 10
SHARD = 65_536  # nodes of a shard at most, and their bytes
SHARD_BYTES = 1 << 26
SPREAD_OVER = 12  # shards at least, where each gets 2,048 nodes
DEGREE = 32
SEARCH_BEAM = 96
RECALL = 0.99  # of the nearest, by SAMPLE queries of each shard
SAMPLE = 64
RELAX = 1.2
LEAF = 4096  # nodes that are compared pair by pair
LEAVES = 4  # of each node
CANDIDATES = 64
ENTRIES = 4096

_NONE = np.uint64(0xFFFFFFFFFFFFFFFE)  # an empty place of a beam: it sorts last and is not open
_ID = np.uint64(0xFFFFFFFF)


def _ranks(groups: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each entry within its group, and the groups' sizes; ``groups`` is sorted."""
    sizes = np.bincount(groups, minlength=count)
    return np.arange(len(groups)) - (np.cumsum(sizes) - sizes)[groups], sizes


def _apart(x: np.ndarray, ids: np.ndarray, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to their queries; by differences, so near copies keep their order."""
    out = np.empty(len(ids), dtype=np.float32)
    for at in range(0, len(ids), 1024):
        some = slice(at, at + 1024)
        apart = x.take(ids[some], axis=0)
        apart -= query.take(rows[some], axis=0)
        out[some] = np.einsum("kd,kd->k", apart, apart)
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search of many queries side by side: the beam's ids and distances, nearest first, and all nodes expanded.

    Searches start at the entries nearest to the query, at more of them the
    wider the beam. Every step expands each query's nearest open nodes. A place
    of the beam is one number: distance, id and whether the node is open, in
    the order of sorting. Missing places hold -1.
    """
    b, n = len(query), len(x)
    wide, first = max(4, beam // 24), min(-(-beam // 6), len(entry))
    if first < len(entry):
        points = x[entry]
        near = np.argpartition(np.einsum("kd,kd->k", points, points) - 2 * (query @ points.T), first - 1, axis=1)[:, :first]
        start = entry[near]
    else:
        start = np.broadcast_to(entry, (b, first))
    # Of node i and query r the place is i << bits | r; the last one, for no node, is marked. In the order of
    # places vectors are read one after the other, and those of the queries are few enough to stay at hand.
    bits, each = (b - 1).bit_length(), np.arange(b, dtype=np.int64)
    seen = np.zeros((n << bits) + 1, dtype=bool)
    seen[-1] = True
    fresh = np.sort((start << bits | each[:, None]).ravel())
    keys = np.full((b, beam), _NONE)
    path = []
    while True:
        seen[fresh] = True
        rows, near = fresh & ((1 << bits) - 1), fresh >> bits
        key = _apart(x, near, query, rows).view(np.uint32).astype(np.uint64)
        key = key << np.uint64(32) | near.view(np.uint64) << np.uint64(1) | np.uint64(1)
        good = np.flatnonzero(key < keys[:, -1].take(rows))
        if len(good):
            rows = rows.take(good)
            order = np.argsort(rows.astype(np.uint16) if bits <= 16 else rows, kind="stable")  # sixteen bits are dealt, not compared
            rows, key = rows.take(order), key.take(good.take(order))
            place, sizes = _ranks(rows, b)
            both = np.full((b, beam + int(sizes.max())), _NONE)
            both[:, :beam] = keys
            both[rows, beam + place] = key
            both.sort(axis=1)
            keys = both[:, :beam].copy()
        open_ = (keys & np.uint64(1)).astype(bool)
        rows, at = np.nonzero(open_ & (np.cumsum(open_, axis=1, dtype=np.int16 if beam < 2**15 else np.int64) <= wide))
        if not len(rows):
            break
        node = ((keys[rows, at] & _ID) >> np.uint64(1)).view(np.int64)
        keys[rows, at] -= np.uint64(1)
        step = np.full((b, wide), -1, dtype=np.int64)
        step[rows, _ranks(rows, b)[0]] = node
        path.append(step)
        links = graph.take(node, axis=0)
        fresh = np.where(links < 0, -1, links.astype(np.int64) << bits | each.take(rows)[:, None]).ravel()
        fresh = fresh[~seen.take(fresh)]
        fresh.sort()
        if len(fresh):
            fresh = fresh[np.concatenate([[True], fresh[1:] != fresh[:-1]])]
    empty = keys == _NONE
    ids = np.where(empty, -1, ((keys & _ID) >> np.uint64(1)).view(np.int64))
    dist = np.where(empty, np.float32(np.inf), (keys >> np.uint64(32)).astype(np.uint32).view(np.float32))
    return ids, dist, np.hstack(path)


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Per node the nearest candidates such that none is closer, by the factor ``relax``, to a nearer one kept; and their squared distances."""
    b = len(own)
    kept, far = np.full((b, degree), -1, dtype=np.int64), np.full((b, degree), np.inf, dtype=np.float32)
    candidates = np.sort(np.where(candidates == own[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    rows, places = np.nonzero(candidates >= 0)
    d = np.full(candidates.shape, np.inf, dtype=np.float32)
    d[rows, places] = _apart(x, candidates[rows, places], x, own[rows])
    order = np.argsort(np.where(candidates >= 0, d, np.float32(np.nan)), axis=1)  # missing ones last
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    width, step = int((candidates >= 0).sum(1).max(initial=0)), degree + degree // 4
    count = np.zeros(b, dtype=np.int64)
    todo = np.arange(b)
    for low in range(0, width, step):
        todo = todo[(count[todo] < degree) & (candidates[todo, low] >= 0)]
        if not len(todo):
            break
        some = candidates[todo, low : low + step]
        alive, m = some >= 0, some.shape[1]
        at = x[own[todo]][:, None]
        apart = x[np.maximum(some, 0)] - at
        if low:
            before = kept[todo]
            apart = np.concatenate([apart, x[np.maximum(before, 0)] - at], axis=1)
        square = np.einsum("bkd,bkd->bk", apart, apart)
        # Of those from ``m`` on, already kept, and of these, each against all of these: 1 where it is no reason to drop.
        pair = np.matmul(apart, apart[:, :m].transpose(0, 2, 1))
        pair *= -2
        pair += square[:, :, None]
        pair += square[:, None, :m]
        spared = pair * (relax * relax) > square[:, None, :m]
        if low:
            spared[:, m:][before < 0] = True
            alive &= spared[:, m:].all(axis=1)
        each = np.arange(len(todo))
        for k in range(m):
            ok = each[alive[:, k] & (count[todo] < degree)]
            if not len(ok):
                continue
            node = todo[ok]
            kept[node, count[node]], far[node, count[node]] = some[ok, k], d[node, low + k]
            count[node] += 1
            alive[ok] &= spared[ok, k]
    return kept, far


def _leaves(x: np.ndarray, ids: np.ndarray, each: int, random: np.random.Generator) -> Iterator[np.ndarray]:
    """Groups of at most LEAF nodes around random ones: every node in the groups of the ``each`` nearest."""
    if len(ids) <= LEAF:
        yield ids
        return
    count = min(-(-2 * each * len(ids) // LEAF), 512)
    leaders = x[random.choice(ids, count, replace=False)]
    square = np.einsum("kd,kd->k", leaders, leaders)
    near = np.concatenate([np.argpartition(square - 2 * (x[ids[at : at + 4096]] @ leaders.T), each - 1, axis=1)[:, :each] for at in range(0, len(ids), 4096)]).ravel()
    members = ids[np.argsort(near, kind="stable") // each]
    for part in np.split(members, np.cumsum(np.bincount(near, minlength=count))[:-1]):
        if len(part) <= LEAF:
            yield part
        elif len(part) < 0.8 * len(ids):
            yield from _leaves(x, part, 1, random)
        else:  # too alike to be told apart
            yield from np.array_split(random.permutation(part), -(-len(part) // LEAF))


def _nearest_within(x: np.ndarray, ids: np.ndarray, wanted: int) -> np.ndarray:
    """The nearest other members of each member of a leaf, in any order (-1: none), and a few more.

    The ``wanted``-th smallest of the least values of so many groups is no less than the ``wanted``-th smallest value.
    """
    n, wanted = len(ids), min(wanted, len(ids) - 1)
    groups, width = 4 * wanted, wanted + wanted // 4 + 1
    points = x[ids]
    points -= points.mean(axis=0)
    square = np.einsum("kd,kd->k", points, points)
    out = np.full((n, width), -1, dtype=np.int64)
    for low in range(0, n, 256):
        d = points[low : low + 256] @ points.T
        d *= -2
        d += square
        b = len(d)
        d[np.arange(b), np.arange(low, low + b)] = np.inf
        if n < 2 * groups:
            out[low : low + b, :wanted] = ids[np.argpartition(d, wanted - 1, axis=1)[:, :wanted]]
            continue
        least = np.partition(d[:, : n // groups * groups].reshape(b, -1, groups).min(axis=1), wanted - 1, axis=1)
        rows, places = np.divmod(np.flatnonzero((d <= least[:, wanted - 1 : wanted]).ravel()), n)
        rank = _ranks(rows, b)[0]
        few = rank < width
        out[low + rows[few], rank[few]] = ids[places[few]]
    return out


def build(x: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """The graph of one shard: rows of neighbours (-1: none), and the nodes where searches may enter.

    Every node is compared with all others of its leaves; pruning keeps diverse
    ones of the nearest, and the edges back are pruned in turn.
    """
    n, random = len(x), np.random.default_rng(1)
    parts = [part for part in _leaves(x, np.arange(n), LEAVES, random) if len(part) > 1]
    each = CANDIDATES if n <= LEAF else CANDIDATES * 3 // 8
    proposed = np.full((n, (1 if n <= LEAF else LEAVES) * (each + each // 4 + 1)), -1, dtype=np.int32)
    used = np.zeros(n, dtype=np.int64)
    for part in parts:
        near = _nearest_within(x, part, each)
        proposed[part[:, None], used[part][:, None] + np.arange(near.shape[1])] = near
        used[part] += near.shape[1]
    graph, far = np.empty((n, degree), dtype=np.int32), np.empty((n, degree), dtype=np.float32)
    for at in range(0, n, 128):
        graph[at : at + 128], far[at : at + 128] = robust_prune(x, np.arange(at, min(at + 128, n)), proposed[at : at + 128], degree, relax)
    del proposed
    graph = _linked_back(x, graph, far, relax)
    return graph, _entries(graph, random.permutation(n))


def _entries(graph: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first nodes in ``order``, and as many of those they don't lead to as it takes to reach every node."""
    reached = np.zeros(len(graph) + 1, dtype=bool)
    reached[-1] = True
    front = order[: min(-(-len(order) // 16), ENTRIES)]
    entries = [front]
    while len(front):
        while len(front):
            reached[front] = True
            near = graph[front].ravel()
            front = np.unique(near[~reached[near]])
        left = order[~reached[order]]
        front = left[: -(-len(left) // 16)]
        entries.append(front)
    return np.concatenate(entries)


def _linked_back(x: np.ndarray, graph: np.ndarray, far: np.ndarray, relax: float) -> np.ndarray:
    """The graph with its edges both ways, pruned; of the edges that reach a node the nearest CANDIDATES are considered."""
    n, degree = graph.shape
    edges = np.flatnonzero(graph >= 0)
    edges = edges[np.lexsort((far.ravel()[edges], graph.ravel()[edges]))]
    target = graph.ravel()[edges]
    rank, sizes = _ranks(target, n)
    few = rank < CANDIDATES
    back = np.full((n, CANDIDATES), -1, dtype=np.int32)
    back[target[few], rank[few]] = edges[few] // degree
    del edges, target, rank, few
    out = np.empty((n, degree), dtype=np.int32)
    alike = np.argsort(np.minimum(sizes, CANDIDATES), kind="stable")
    for at in range(0, n, 128):
        own = alike[at : at + 128]
        width = min(int(sizes[own].max()), CANDIDATES)
        out[own] = robust_prune(x, own, np.hstack([graph[own], back[own, :width]]), degree, relax)[0]
    return out


def fitted_beam(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, sample: np.ndarray, wanted: int, beam: int) -> int:
    """The beam, ``beam`` or wider, that finds RECALL of the ``wanted`` nodes nearest to each query of a sample; at most all nodes."""
    wanted = min(wanted, len(x))
    few = min(2 * wanted + 64, len(x))
    likely = np.argpartition(np.einsum("kd,kd->k", x, x) - 2 * (sample @ x.T), few - 1, axis=1)[:, :few]
    last = np.partition(_exact(x, likely, sample), wanted - 1, axis=1)[:, wanted - 1 : wanted]
    while beam < len(x):
        found = beam_search(x, graph, entry, sample, beam)[0]
        near = (found >= 0) & (_exact(x, found, sample) <= last * (1 + 1e-9))
        if np.minimum(near.sum(1), wanted).sum() >= RECALL * wanted * len(sample):
            return beam
        beam += beam // 2
    return len(x)


def _exact(x: np.ndarray, ids: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances of each query row to its own row of ids, in double precision."""
    return np.array([np.sqrt(((x[near].astype(np.float64) - one) ** 2).sum(1)) for near, one in zip(ids, query.astype(np.float64), strict=True)])


def _answers(x: np.ndarray, ids: np.ndarray, graph: np.ndarray, entry: np.ndarray, query_ids: np.ndarray, query: np.ndarray, wanted: int, beam: int) -> Iterator[pa.RecordBatch]:
    """(query_id, rep, score) of the nearest nodes of a shard, for each query."""
    for at in range(0, len(query), 256):
        some = query[at : at + 256]
        found = beam_search(x, graph, entry, some, max(beam, wanted))[0]
        rows, places = np.nonzero(found >= 0)
        near, exact = found[rows, places], _exact(x, found, some)[rows, places]
        order = np.lexsort((ids[near], exact, rows))
        top = order[_ranks(rows, len(some))[0] < wanted]  # rows are in order before and after
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[at : at + 256][rows[top]]), pa.array(ids[near[top]]), pa.array(exact[top])], ["query_id", "rep", "score"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """The slices of batches that are of one shard, and all nodes or all queries: shard, whether queries, ids and vectors."""
    for batch in batches:
        shards, asked = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        ends = np.flatnonzero((shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])) + 1
        for low, high in pairwise([0, *ends.tolist(), len(shards)]):
            if low < high:
                ids, vectors = (batch.column(c).slice(low, high - low) for c in (2, 3))
                yield int(shards[low]), bool(asked[low]), np.array(ids), matrix(vectors).copy()


def _searched(batches: Iterator[pa.RecordBatch], wanted: int, likely: int, beam: int) -> Iterator[pa.RecordBatch]:
    """The answers of whole shards. Of each its nodes come first, which are made into a graph, and then its queries."""
    joined = lambda parts: [np.concatenate(part) for part in zip(*parts, strict=True)]
    for _, runs in groupby(_runs(batches), key=lambda run: run[0]):
        nodes, waiting, made = [], [], None
        for _, asked, *run in runs:
            if not asked:
                nodes.append(run)
            elif made:
                yield from _answers(*made, *run, wanted, width)
            elif nodes:
                waiting.append(run)
                if sum(len(ids) for ids, _ in waiting) >= SAMPLE:
                    made, width = _made(*joined(nodes), joined(waiting)[1], likely, beam)
                    nodes = []
                    yield from _answers(*made, *joined(waiting), wanted, width)
        if waiting and made is None:
            made, width = _made(*joined(nodes), joined(waiting)[1], likely, beam)
            yield from _answers(*made, *joined(waiting), wanted, width)


def _made(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, likely: int, beam: int) -> tuple[tuple, int]:
    graph, entry = build(x)
    return (x, ids, graph, entry), fitted_beam(x, graph, entry, queries[:SAMPLE], likely, beam)


def nearest(table: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each query, itself apart.

    ``queries``: the vec_ids of the table to search for. Equal vectors are one
    node; all nodes are dealt into shards of about ``shard`` nodes at most, each
    with a graph of its own, so building is linear and no task holds more than
    a shard and some queries. Every query is searched in every shard, with a
    beam of ``beam`` nodes or as many more as a sample of the queries needs
    there; shards' answers are merged by exact distance in double precision,
    ties by smaller vec_id. A class of equal vectors answers with its k + 1
    smallest ids, which is all that can be among the k nearest.

    Vectors are searched among those of their own length, one length after the
    other. Vectors that are null, zero or hold null or non-finite components
    take no part; rows of one vec_id count once. Queries with fewer than k
    candidates get all. Extra columns are ignored.
    """
    rows = stored(taking_part(table), "vectors")
    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    found = None
    for length in lengths(rows):
        part = _nearest(rows.filter(F.col("n") == length), length, wanted, k, shard, beam)
        found = part if found is None else found.unionByName(part)
    return table.sparkSession.createDataFrame([], RANKED) if found is None else found


RANKED = "query_id long, rank int, vec_id long, score double"


def shard_count(nodes: int, most: int) -> int:
    """As few shards as their size allows, since a search visits fewer nodes of one large graph; smaller tables still go to several tasks."""
    return max(-(-nodes // most), min(-(-nodes // 2048), SPREAD_OVER), 1)


def _nearest(rows: DataFrame, length: int, queries: DataFrame, k: int, shard: int, beam: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    size = 8 if rows.schema["embedding"].dataType.elementType.typeName() == "double" else 4
    keys = ["k1", "k2"]
    # In two steps, so a frequent vector is cut down in many tasks first.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    lowest = lambda *by: Window.partitionBy(*by).orderBy("vec_id")
    few = rows.select("vec_id", *keys, salt.alias("salt")).withColumn("r", F.row_number().over(lowest(*keys, "salt"))).filter(F.col("r") <= k + 1)
    few = few.select("vec_id", *keys).withColumn("r", F.row_number().over(lowest(*keys))).filter(F.col("r") <= k + 1)
    few = stored(few, "members")
    heads = few.filter("r = 1").select("vec_id", *keys, F.col("vec_id").alias("rep"))
    members = few.join(heads.select(*keys, "rep"), keys).select("rep", F.col("vec_id"))
    shards = shard_count(heads.count(), min(shard, max(SHARD_BYTES // (size * length), 1)))
    # Of the nearest of all, a shard holds about so many at most.
    likely = min(k + 1, math.ceil(k / shards + 3 * math.sqrt(k / shards)))
    nodes = rows.join(heads.select("vec_id"), "vec_id", "left_semi").select("vec_id", "embedding")
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("long")).withColumn("asked", F.lit(False))
    asked = rows.join(queries, "vec_id", "left_semi").select("vec_id", "embedding")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    asked = stored(asked, "queries").withColumn("shard", everywhere).withColumn("asked", F.lit(True))
    dealt = nodes.unionByName(asked).select("shard", "asked", "vec_id", "embedding")
    # With twice as many parts as shards no two shards share one.
    dealt = dealt.repartitionByRange(2 * shards, "shard").sortWithinPartitions("shard", "asked", "vec_id")
    found = stored(dealt.mapInArrow(lambda batches: _searched(batches, k + 1, likely, beam), "query_id long, rep long, score double"), "found")
    answers = found.join(members, "rep").filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    return nearest(table, table.filter("vec_id % 100 = 0").select("vec_id"))
