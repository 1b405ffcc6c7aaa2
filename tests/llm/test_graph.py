"""Operator 1: what a graph costs, what searches find in it, and shards that come in pieces."""

import time

import numpy as np
import pyarrow as pa

from scanledger.llm import graph


def _seconds(work):
    began = time.thread_time()
    work()
    return time.thread_time() - began


def _nearest(x, queries, wanted):
    return np.argsort(((queries[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2), axis=1, kind="stable")[:, :wanted]


def _recall(found, want):
    return np.mean([len(set(f.tolist()) & set(w.tolist())) for f, w in zip(found, want, strict=True)]) / want.shape[1]


def test_a_node_costs_less_than_half_a_millisecond():
    x = np.random.default_rng(1).normal(size=(3000, 64)).astype(np.float32)
    graph.build(x[:300])
    millisecond = min(_seconds(lambda: sum(range(50_000))) for _ in range(20))  # about one, on a machine of usual speed
    assert _seconds(lambda: graph.build(x)) < 0.5 * len(x) * millisecond


def test_a_search_goes_to_few_large_graphs():
    assert [graph.shard_count(n, graph.SHARD) for n in (1, 2048, 2049, 10_256, 51_282, 615_384, 1_000_000)] == [1, 1, 2, 6, 12, 12, 16]
    assert graph.shard_count(244, 64) == 4


def test_tight_groups_without_an_entry_are_found():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 16))
    x = (np.repeat(centres, 20, axis=0) + 1e-3 * rng.normal(size=(6000, 16))).astype(np.float32)
    queries = (centres + 1e-3 * rng.normal(size=centres.shape)).astype(np.float32)
    made, entry = graph.build(x)
    reached = np.zeros(len(x) + 1, dtype=bool)
    front = entry
    while len(front):
        reached[front] = True
        front = np.unique(made[front])
        front = front[(front >= 0) & ~reached[front]]
    assert reached[:-1].all()
    assert _recall(graph.beam_search(x, made, entry, queries, 96)[0], _nearest(x, queries, 10)) >= 0.97


def test_the_beam_widens_until_the_recall_is_met():
    rng = np.random.default_rng(3)
    x, queries = rng.normal(size=(6000, 48)).astype(np.float32), rng.normal(size=(60, 48)).astype(np.float32)
    made, entry = graph.build(x)
    want = _nearest(x, queries, 11)
    beam = graph.fitted_beam(x, made, entry, queries, 11, 12)
    assert 12 < beam < 1000
    assert _recall(graph.beam_search(x, made, entry, queries, 12)[0], want) < graph.RECALL <= _recall(graph.beam_search(x, made, entry, queries, beam)[0], want)
    assert graph.fitted_beam(x[:40], *graph.build(x[:40]), queries, 11, 12) <= 40


def test_shards_in_pieces_are_answered_whole():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    query_ids = np.arange(0, 700, 5)  # more than a sample
    rows = [(s, False, i, x[i]) for s, ids in ((0, range(0, 300)), (1, range(300, 700))) for i in ids]
    rows += [(s, True, i, x[i]) for s in (0, 1, 2) for i in query_ids] + [(3, False, i, x[i]) for i in range(9)]
    rows += [(4, False, i, x[i]) for i in range(5)] + [(4, True, 0, x[0])]
    rows.sort(key=lambda r: r[:3])
    kind = pa.list_(pa.float64())
    table = pa.table({"shard": [r[0] for r in rows], "asked": [r[1] for r in rows], "id": [r[2] for r in rows], "embedding": pa.array([r[3].tolist() for r in rows], kind)})
    found = {}
    for batch in graph._searched(iter(table.to_batches(max_chunksize=37)), 11, 11, 96):
        for query, rep, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(query, []).append((score, rep))
    assert sorted(found) == query_ids.tolist()
    assert len(found[0]) == 11 + 11 + 5 and all(len(found[i]) == 22 for i in found if i)
    best = np.array([[rep for _, rep in sorted(set(found[i]))[:11]] for i in query_ids])
    assert _recall(best, _nearest(x, x[query_ids], 11)) >= 0.98
    assert all(score == np.sqrt(((x[i] - x[rep]) ** 2).sum()) for i in found for score, rep in found[i])


def test_every_query_of_several_shards_is_answered(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[850:] = x[:50]  # exact copies
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in graph.nearest(table, table.filter("vec_id % 4 = 0").select("vec_id"), shard=100).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert sorted(found) == list(range(0, 900, 4)) and all(sorted(a) == list(range(1, 11)) for a in found.values())
    want = [[i for i in near.tolist() if i != q][:10] for q, near in zip(range(0, 900, 4), _nearest(x, x[::4], 11), strict=True)]
    assert np.mean([len(set(found[q].values()) & set(w)) for q, w in zip(sorted(found), want, strict=True)]) >= 9.9
