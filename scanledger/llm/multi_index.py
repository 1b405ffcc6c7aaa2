"""Near-duplicate vectors by an inverted multi-index (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, load, stored
from .vectors import lengths, matrix, taking_part

COSINE = 0.9
RECALL = 0.95
SAMPLE = 16_384
CELL = 64  # vectors a cell holds on average, by which codebooks grow
MOST_CODES = 1024
MEMBERS, VISITORS = 2048, 8192
BATCH = 1024  # vectors whose cells are looked up together, while they visit up to 64


@dataclass(frozen=True)
class Grid:
    """Two codebooks, whose products are the cells, and how many cells a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int
    recall: float = 1.0  # as measured on the sample

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(unit[:, :half], self.first), _squared(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each vector, in order of the summed distances of the halves.

        The t-th nearest pair of ranks (a, b) has (a + 1)(b + 1) <= t, because
        all pairs below it in both ranks come before it: so the multi-sequence
        order needs only these.
        """
        visits = visits or self.visits
        one, two = self.distances(unit)
        order_one, order_two = (np.argsort(d, axis=1, kind="stable")[:, :visits] for d in (one, two))
        near_one, near_two = np.take_along_axis(one, order_one, 1), np.take_along_axis(two, order_two, 1)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(near_one.shape[1]), np.arange(near_two.shape[1]), indexing="ij"))
        few = (a + 1) * (b + 1) <= visits
        a, b = a[few], b[few]
        order = np.argsort(near_one[:, a] + near_two[:, b], axis=1, kind="stable")[:, :visits]
        cells = order_one[:, a].astype(np.int64) * len(self.second) + order_two[:, b]
        return np.take_along_axis(cells, order, 1)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _codebook(points: np.ndarray, codes: int, turns: int = 12) -> np.ndarray:
    rng = np.random.default_rng(10)
    centres = points[rng.permutation(len(points))[:codes]].copy()
    for _ in range(turns):
        own = _squared(points, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL) -> Grid:
    """Codebooks from a sample of unit vectors, and as many visits as reach ``recall``.

    The visits are measured: for every sampled vector a partner exactly at the
    cosine asked for, in a random direction, must lie in a visited cell. Links
    are looked for from both ends, so fewer than the square of the rest is lost.
    Visits double until that is met; the last step visits the whole grid. Where
    codebooks are at their bound, cells grow instead and are split into blocks.
    """
    codes = 2 ** round(np.log2(max(np.sqrt(rows / CELL), 2)))
    codes = int(min(codes, MOST_CODES, max(len(sample), 1)))
    half = max(sample.shape[1] // 2, 1)
    first, second = _codebook(sample[:, :half], codes), _codebook(sample[:, half:], codes)
    probe = sample[:2048]
    noise = np.random.default_rng(11).normal(size=probe.shape)
    noise -= (noise * probe).sum(1, keepdims=True) * probe
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partner = cosine * probe + np.sqrt(1 - cosine**2) * noise
    whole = len(first) * len(second)
    grid = Grid(first, second, whole)
    wanted = grid.cells(partner, 1)
    visits = min(4, whole)
    while visits < whole:
        at_once = max(BATCH * 64 // visits, 1)
        hits = [
            (grid.cells(probe[at : at + at_once], visits) == wanted[at : at + at_once]).any(axis=1) for at in range(0, len(probe), at_once)
        ]
        reached = float(np.concatenate(hits).mean())
        if reached >= recall:
            return Grid(first, second, visits, reached)
        visits = min(2 * visits, whole)
    return grid  # every cell is visited, so nothing is missed


def _joined(table: pa.Table, grid: Grid, cosine: float) -> pa.Table:
    """Links between the members and the visitors of one block of a cell: weights per vector, and edges that join what is linked."""
    is_member = np.asarray(table["member"])
    ids, copies, own = (np.asarray(table[c]) for c in ("rep", "copies", "own"))
    unit = unit_rows(matrix(table["embedding"]))
    members, visitors = np.flatnonzero(is_member), np.flatnonzero(~is_member)
    out_id, out_weight, edge_a, edge_b = [], [], [], []
    if len(members) and len(visitors):
        at_once = max(BATCH * 64 // max(grid.visits, 64), 1)
        visited = np.concatenate([grid.cells(unit[members[at : at + at_once]]) for at in range(0, len(members), at_once)])
        found_v, found_m = [], []
        for at in range(0, len(visitors), 1024):
            block = visitors[at : at + 1024]
            v, m = np.nonzero(unit[block] @ unit[members].T >= cosine)
            found_v.append(block[v])
            found_m.append(m)
        v, m = np.concatenate(found_v), np.concatenate(found_m)
        differ = ids[v] != ids[members[m]]
        v, m = v[differ], m[differ]
        # The member finds the pair from its own end if it visits the visitor's cell; else it is counted here.
        back = np.zeros(len(v), dtype=bool)
        for at in range(0, len(v), 65_536):
            s = slice(at, at + 65_536)
            back[s] = (visited[m[s]] == own[v[s], None]).any(axis=1)
        weights = np.zeros(len(ids), dtype=np.int64)
        np.add.at(weights, v, copies[members[m]])
        np.add.at(weights, members[m[~back]], copies[v[~back]])
        label, one, two = ids.copy(), v, members[m]
        while len(one):
            least = label.copy()
            np.minimum.at(least, one, label[two])
            np.minimum.at(least, two, label[one])
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(weights)
        out_id, out_weight = ids[some], weights[some]
        joined = np.flatnonzero(label != ids)
        edge_a, edge_b = label[joined], ids[joined]
    n, e = len(out_id), len(edge_a)
    none = pa.nulls(e, pa.int64())
    return pa.table(
        {
            "rep": pa.concat_arrays([pa.array(out_id, pa.int64()), none]),
            "weight": pa.concat_arrays([pa.array(out_weight, pa.int64()), none]),
            "a": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(edge_a, pa.int64())]),
            "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(edge_b, pa.int64())]),
        }
    )


def near_vectors(table: DataFrame, cosine: float = COSINE, recall: float = RECALL, most_sample: int = SAMPLE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept, for links of ``cosine`` or more in double precision.

    Equal vectors are one class and go on as its smallest id with their number.
    Codebooks are fitted on the ``most_sample`` vectors of smallest hash; every
    vector is indexed in its nearest cell and visits the nearest cells of the
    product grid. A pair is found when either visits the other's cell and then
    verified. Large cells are split into blocks of members and visitors; a
    block gives sums per vector and edges to the least linked id, never its
    pairs.

    Vectors are compared with those of their own length, one length after the
    other. Vectors that are null, zero or hold null or non-finite components
    link with nothing; rows of one vec_id count once; rows without vec_id have
    no component and are kept. Extra columns are ignored.
    """
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    rows = stored(taking_part(table), "vectors")
    placed = None
    for length in lengths(rows):
        found = _linked(rows.filter(F.col("n") == length), cosine, recall, most_sample)
        placed = found if placed is None else placed.unionByName(found)
    if placed is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = ids.join(placed, "vec_id", "left")
    return known.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(rows: DataFrame, cosine: float, recall: float, most_sample: int) -> DataFrame:
    """(vec_id, n_links, part) of vectors of one length."""
    classes = stored(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = rows.join(classes, ["k1", "k2"]).filter("vec_id = rep").select("rep", "copies", "embedding")
    reps = stored(reps, "reps")
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("rep", F.lit(10)), "rep").limit(most_sample).select("embedding").toArrow()
    grid = fit(unit_rows(matrix(sample["embedding"])), n, cosine, recall)
    at_once = max(BATCH * 64 // max(grid.visits, 64), 1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                cells = grid.cells(unit_rows(matrix(part["embedding"])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*part.schema.names, "cells"])

    schema = T.StructType([*reps.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    seen = stored(reps.mapInArrow(visit, schema).withColumn("own", F.col("cells")[0]), "visits")
    visits = seen.select("rep", F.explode("cells").alias("cell"))
    counts = visits.groupBy("cell").agg(F.count("*").alias("visitors"))
    owned = seen.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("members"))
    sizes = stored(
        counts.join(owned, "cell").select(
            "cell", F.ceil(F.col("members") / MEMBERS).cast("int").alias("m"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("v")
        ),
        "cells",
    )
    columns = ["rep", "copies", "own", "embedding"]
    salt = lambda number: F.pmod(F.xxhash64("rep"), F.col(number)).cast("int")
    spread = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    members = seen.withColumn("cell", F.col("own")).join(sizes, "cell").withColumn("mb", salt("m")).withColumn("vb", spread("v"))
    visitors = seen.withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn("vb", salt("v")).withColumn("mb", spread("m"))
    both = members.select("cell", "mb", "vb", F.lit(True).alias("member"), *columns).unionByName(
        visitors.select("cell", "mb", "vb", F.lit(False).alias("member"), *columns)
    )
    found = both.groupBy("cell", "mb", "vb").applyInArrow(lambda part: _joined(part, grid, cosine), "rep long, weight long, a long, b long")
    found = stored(found, "found")
    weights = found.filter("rep IS NOT NULL").groupBy("rep").agg(F.sum("weight").alias("weight"))
    parts = components(found.filter("a IS NOT NULL").select("a", "b").distinct(), "a", "b")
    judged = classes.join(weights, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left")
    judged = judged.select("k1", "k2", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    return rows.select("vec_id", "k1", "k2").join(judged, ["k1", "k2"]).select("vec_id", "n_links", "part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))
