"""Near-duplicate documents by MinHash bands and odd sketches (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, numbered, packed, stored, unpacked

BANDS, ROWS = 32, 5
BITS = 512
WORDS = 5  # words in a shingle
PERCENT = 80
BLOCK = 256
BROADCAST_ROWS = 1_000_000
SKETCH = [f"s{i}" for i in range(BITS // 64)]

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xA0761D6478BD642F)


def word_hash() -> Callable[[bytes], int]:
    import xxhash

    return lru_cache(maxsize=100_000)(xxhash.xxh3_64_intdigest)


def shingles(text: str | None, size: int, hashed: Callable[[bytes], int]) -> np.ndarray:
    """The sorted different shingles of a text as 64-bit hashes.

    Words are cut at ASCII white space and A-Z lower-cased. Fewer words than
    ``size`` are one shingle; no words are none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))
    span = min(size, len(words))
    total = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for at in range(span):
        total = total * _ODD + h[at : len(h) - span + at + 1]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each hash function over all shingles, a slice of them at a time."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        values = hashes[None, at : at + 512] * seeds[:, :1]
        values += seeds[:, 1:]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def _seeds(count: int) -> np.ndarray:
    seeds = np.random.default_rng(4).integers(0, 2**63, size=(count, 2), dtype=np.uint64)
    seeds[:, 0] |= np.uint64(1)
    return seeds


def band_keys(best: np.ndarray) -> np.ndarray:
    folded = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for column in best.reshape(BANDS, ROWS).T:
        folded = _mix(folded * _ODD + column)
    return folded.astype(np.int64)


def odd_sketch(best: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of how many samples fall on each bit; equal samples cancel out in an XOR."""
    spots = _mix(best + np.arange(len(best), dtype=np.uint64) * _ODD) >> np.uint64(64 - int(math.log2(BITS)))
    parity = np.bincount(spots.astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64)


def most_bits(percent: int = PERCENT, deviations: float = 5.0) -> int:
    """How many bits of the XOR may be set for a similarity of ``percent``: what is expected, and so many deviations."""
    samples, share = BANDS * ROWS, 1 - percent / 100
    expected = lambda different: BITS / 2 * (1 - math.exp(-4 * different / BITS))
    mean = expected(samples * share)
    from_samples = math.sqrt(samples * share * (1 - share)) * 2 * math.exp(-4 * samples * share / BITS)
    from_sketch = math.sqrt(BITS * (mean / BITS) * (1 - mean / BITS))
    return math.ceil(mean + deviations * math.hypot(from_samples, from_sketch))


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the whole set, band keys and the odd sketch. Text by text, in Python tasks."""
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, " + ", ".join(f"{s} long" for s in SKETCH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed, seeds = word_hash(), _seeds(BANDS * ROWS)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digests, keys, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words, hashed)
                    best = signature(found, seeds)
                    n.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(band_keys(best) if len(found) else [])
                    sketches.append(odd_sketch(best))
                bits = np.array(sketches, dtype=np.int64).reshape(-1, len(SKETCH))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, bits.T)],
                    ["doc_id", "n_shingles", "digest", "keys", *SKETCH],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the documents named, from their whole texts."""
    chosen = ids.select(F.col("id").alias("doc_id"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(text, words, hashed).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left_semi")
    return texts.mapInArrow(work, "doc_id long, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = stored(_sets(docs, ids, words), "sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * same >= percent * (F.size("set_a") + F.size("set_b") - same)).select("a", "b").distinct()


def _alike(a: str, b: str, percent: int) -> Column:
    """What a pair must meet to be verified at all: sizes near enough and few bits of the XOR set."""
    bits = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    low, high = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * low >= percent * high) & (bits <= most_bits(percent))


def _across(docs: DataFrame, mixed: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different parts of a bucket, as many as join what is linked.

    The largest part of a bucket and the rest are cut into blocks (places below
    and from 0 on). Every pair of blocks of the rest, or of one and the other,
    is a group of at most twice BLOCK members with their sets. Sketches are compared first and whole sets where they
    allow it; a pair is left to the first band it shares. Groups give links
    that join parts, never their pairs.
    """
    sets = _sets(docs, mixed.select(F.col("rep").alias("id")).distinct(), words).withColumnRenamed("doc_id", "rep")
    full = stored(reps.join(sets, "rep").dropDuplicates(["rep"]), "full")
    # Members of a bucket's largest part need the others only, so they are copied as rarely as those are few.
    sizes = mixed.groupBy("key", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = mixed.join(largest, "key").select(
        "key",
        "rep",
        "part",
        (F.col("part") == F.col("largest.part")).alias("main"),
        blocks(F.col("largest.n")).alias("main_blocks"),
        blocks(F.col("all") - F.col("largest.n")).alias("rest_blocks"),
    )
    own = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("rep"), "main_blocks")).otherwise(F.pmod(F.xxhash64("rep"), "rest_blocks"))
    other = F.sequence(F.when(F.col("main"), 0).otherwise(-F.col("main_blocks")), F.col("rest_blocks") - 1)
    placed = placed.withColumn("own", own.cast("int")).withColumn("other", F.explode(other))
    placed = placed.select("key", "rep", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    limit = most_bits(percent)

    def linked(group: pa.Table) -> pa.Table:
        ids, part, own, size = (np.asarray(group[c]) for c in ("rep", "part", "own", "n_shingles"))
        i, j, key = (group[c][0].as_py() for c in ("i", "j", "key"))
        keys = np.asarray(group["keys"].combine_chunks().flatten()).reshape(len(ids), BANDS)
        bits = np.stack([np.asarray(group[s]) for s in SKETCH], axis=1).view(np.uint64)
        band = int((keys[0] == key).argmax())
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        differ = np.bitwise_count(bits[left][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
        low, high = (f(size[left][:, None], size[right][None, :]) for f in (np.minimum, np.maximum))
        likely = (differ <= limit) & (100 * low >= percent * high) & (part[left][:, None] != part[right][None, :])
        likely &= ids[left][:, None] != ids[right][None, :]
        u, v = np.nonzero(likely)
        u, v = left[u], right[v]
        if i == j:
            u, v = u[ids[u] < ids[v]], v[ids[u] < ids[v]]
        first = ~(keys[u][:, :band] == keys[v][:, :band]).any(axis=1)
        u, v = u[first], v[first]
        root = {p: p for p in part.tolist()}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        out = []
        values: dict[int, np.ndarray] = {}
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            one, two = find(int(part[x])), find(int(part[y]))
            if one == two:
                continue
            for k in (x, y):
                if k not in values:
                    values[k] = np.asarray(group["shingles"][k].values)
            same = len(np.intersect1d(values[x], values[y], assume_unique=True))
            if 100 * same >= percent * (len(values[x]) + len(values[y]) - same):
                root[max(one, two)] = min(one, two)
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return placed.join(full, "rep").groupBy("key", "i", "j").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents with equal sets are one class and go on as its smallest id. In
    every bucket of a band all members are first tried against its smallest
    member: as many pairs as rows. Where that leaves a bucket of three or more
    in several components, members of different components are compared in
    blocks that give out only links. All links are confirmed on the whole sets. A pair of similarity 0.8 shares no band with probability 3e-6.

    Null and empty texts and texts of white space have no shingles and link
    with nothing; rows without doc_id have no component and are kept. Rows with
    one doc_id are one document. Extra columns are ignored.
    """
    rows = stored(sketched(docs, words), "sketches")
    linked = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(linked.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = linked.join(classes, "digest").filter("doc_id = rep").select("rep", "n_shingles", "keys", *SKETCH)
    reps = stored(reps, "reps")
    bands = reps.select("rep", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("members"))
    members = stored(bands.join(buckets.filter("low < high"), "key").select("key", "rep", "low", "members"), "members")

    sketches = reps.select("rep", "n_shingles", *SKETCH)
    stars = members.filter("rep > low").select(F.col("low").alias("x"), F.col("rep").alias("y")).distinct()
    stars = stars.join(sketches.alias("a"), F.col("x") == F.col("a.rep")).join(sketches.alias("b"), F.col("y") == F.col("b.rep"))
    stars = stored(stars.filter(_alike("a", "b", percent)).select(F.col("x").alias("a"), F.col("y").alias("b")), "stars")
    links = stored(verified(docs, stars, words, percent), "links")
    parts = stored(components(links, "a", "b"), "parts")

    tagged = members.filter("members > 2").join(parts, F.col("rep") == F.col("id"), "left")
    tagged = stored(tagged.select("key", "rep", "members", F.coalesce("component", "rep").alias("part")), "tagged")
    mixed = tagged.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    mixed = stored(tagged.join(mixed, "key"), "mixed")
    if not mixed.isEmpty():
        more = stored(_across(docs, mixed, reps, words, percent), "more")
        parts = stored(components(links.union(more), "a", "b"), "parts")

    found = classes.join(parts, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("part"))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    joined = rows.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return joined.select("doc_id", "n_shingles", F.when(linked, F.col("part")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group that near-duplicate links join, that of the smallest doc_id, with the columns given.

    Where ids are null or repeated, rows are numbered in the order of doc_id
    (null last) and text hash, and each row is a document of its own: copies
    go whether or not their ids tell them apart. Texts without words all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unclear = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if unclear.isEmpty():
        gone = stored(near_duplicates(docs, **settings).filter(~F.col("kept")).select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*columns)
    # The last key tells equal rows apart, so that many of them do not meet in one task.
    keyed = {"doc_id": F.col("doc_id"), "text": F.col("text"), "hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()}
    marked = packed(docs, "text", **keyed)
    rows = stored(numbered(marked, [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("at")], "place"), "rows")
    judged = near_duplicates(rows.select(F.col("place").alias("doc_id"), "text"), **settings)
    gone = stored(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("place")), "gone")
    return rows.join(gone, "place", "left_anti").select(*unpacked(docs.columns, text=F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), words=2)


def oracle(words: int = 2) -> str:
    """Every pair that shares a shingle, compared on whole sets, and the reachable ids by recursion."""
    return rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
               ELSE [array_to_string(words[i:i + {words - 1}], ' ') FOR i IN range(1, len(words) - {words} + 2)] END) AS shingles FROM w
    ), e AS (
        SELECT doc_id, unnest(shingles) AS shingle FROM s
    ), p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * same >= 80 * (len(x.shingles) + len(y.shingles) - same)
    ), both_ways AS (
        SELECT a, b FROM l UNION SELECT b, a FROM l
    ), r AS (
        SELECT doc_id AS id, doc_id AS reached FROM s
        UNION
        SELECT r.id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.reached
    ), c AS (
        SELECT id, min(reached) AS component_id FROM r GROUP BY id
    )
    SELECT s.doc_id, len(shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
    """
