"""Periodic runs of words by difference-cover extensions (operator 13)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, crc32_sql, load, words

# A difference cover; every difference modulo 31 is one of two members, once.
COVER_MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)

LEAST_LENGTH = 6  # words in a run
LEAST_EXPONENT = 4  # periods in a run
GROUP_WORDS = 100_000  # words of short documents that are searched together

RUNS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]),
    False,
)


class Extensions:
    """Longest common extensions of suffixes of one array of word ids.

    Only suffixes that begin at cover positions (six of 31) are sorted: by their
    first 31 words, then by doubling among themselves, as a cover position plus
    a multiple of 31 is one again. Any two positions reach two sorted suffixes
    after the same number of words, under 31; these are compared, the rest is
    the least common prefix between the two places in the order, from a sparse
    table. No two suffixes may be equal: a last id that occurs once will do.
    """

    def __init__(self, ids: np.ndarray):
        v, self.n = COVER_MODULUS, len(ids)
        self.ids = np.concatenate([ids, np.zeros(v, dtype=ids.dtype)])
        slot = np.full(v, -1, dtype=np.int64)
        slot[list(COVER)] = np.arange(len(COVER))
        self.slot = slot
        # How far two residues are from the next pair of cover positions.
        inside = slot >= 0
        shift = np.arange(v)
        both = inside[(shift[:, None, None] + shift[None, None, :]) % v] & inside[(shift[None, :, None] + shift[None, None, :]) % v]
        self.ahead = both.argmax(axis=2)
        positions = np.arange(self.n)
        self.samples = positions[inside[positions % v]]
        self._sort()

    def _sample(self, positions: np.ndarray) -> np.ndarray:
        return positions // COVER_MODULUS * len(COVER) + self.slot[positions % COVER_MODULUS]

    def _sort(self) -> None:
        m = len(self.samples)
        bits = max(int(self.ids.max()).bit_length(), 1)
        per = max(62 // bits, 1)
        keys = []
        for at in range(0, COVER_MODULUS, per):
            key = np.zeros(m, dtype=np.int64)
            for t in range(at, min(at + per, COVER_MODULUS)):
                key = (key << bits) | self.ids[self.samples + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, dtype=bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        levels = [self._ranks(order, new)]
        jump = len(COVER)
        while levels[-1].max(initial=0) + 1 < m:
            later = np.full(m, -1, dtype=np.int64)
            later[: max(m - jump, 0)] = levels[-1][jump:]
            key = levels[-1] * (m + 1) + later + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(m, dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            levels.append(self._ranks(order, new))
            jump *= 2
        self.rank = levels[-1]
        self._prefixes(order, levels)

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        ranks = np.empty(len(order), dtype=np.int64)
        ranks[order] = np.cumsum(new)
        return ranks

    def _prefixes(self, order: np.ndarray, levels: list[np.ndarray]) -> None:
        """The sparse table of common prefixes of neighbours in the order."""
        m, v = len(order), COVER_MODULUS
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(levels))):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[level][a[inside]] == levels[level][b[inside]]]
            common[same] += v << level
            a[same] += len(COVER) << level
            b[same] += len(COVER) << level
        first, second = self.samples[order[:-1]] + common, self.samples[order[1:]] + common
        common += self._compared(first, second, np.full(len(common), v))
        self.least = np.zeros((max(len(common), 1).bit_length(), max(len(common), 1)), dtype=np.int32)
        self.least[0, : len(common)] = common
        for level in range(1, len(self.least)):
            half = 1 << (level - 1)
            self.least[level] = self.least[level - 1]
            self.least[level, :-half] = np.minimum(self.least[level - 1, :-half], self.least[level - 1, half:])

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, ``most`` at the most."""
        length = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero(most > 0)
        step = 0
        while len(going):
            x, y = i[going] + step, j[going] + step
            last = self.n
            equal = (x < last) & (y < last)
            equal &= self.ids[np.minimum(x, last)] == self.ids[np.minimum(y, last)]
            going = going[equal]
            step += 1
            length[going] = step
            going = going[most[going] > step]
        return length

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j (never the same) have in common."""
        ahead = self.ahead[i % COVER_MODULUS, j % COVER_MODULUS]
        length = self._compared(i, j, ahead)
        reach = np.flatnonzero(length == ahead)
        first = self.rank[self._sample(i[reach] + ahead[reach])]
        second = self.rank[self._sample(j[reach] + ahead[reach])]
        low, high = np.minimum(first, second), np.maximum(first, second)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        length[reach] += np.minimum(self.least[level, low], self.least[level, high - (1 << level.astype(np.int64))])
        return length


def _grid(n: int, longest: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, periods): every multiple of every period up to ``longest``, some periods at a time."""
    period = 1
    while period <= longest:
        until = min(longest, period + max(most * period // max(n, 1), 1) - 1)
        periods = np.arange(period, until + 1)
        counts = np.maximum((n - 1) // periods, 0)
        each = np.repeat(periods, counts)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield nth * each, each
        period = until + 1


def runs_of(
    ids: np.ndarray, sizes: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs, by start, then period.

    ``ids`` holds documents of ``sizes`` words one after the other, each closed
    by an id that occurs nowhere else. A run of period p covers a multiple g of
    p within its first p words, and the words at g and g + p go on alike for
    2p + 1 words or more (the exponent being 4 or more); so only such g are
    looked at, and only the p words before them for the start. A stretch has
    one entry per multiple of its period; the smallest remains.
    """
    if least_exponent < 3:
        raise ValueError("an exponent below 3 would need extensions from every multiple")
    n = len(ids)
    first = np.repeat(np.cumsum(sizes + 1) - (sizes + 1), sizes + 1)
    extensions = Extensions(ids) if n > 1 else None
    found = [np.zeros((0, 3), dtype=np.int64)]
    for g, p in _grid(n, int(sizes.max(initial=0)) // least_exponent):
        hit = np.flatnonzero((ids[g] == ids[g + p]) & (first[g] == first[g + p]))
        g, p = g[hit], p[hit]
        forward = extensions.common(g, g + p)
        hit = forward > (least_exponent - 2) * p
        g, p, forward = g[hit], p[hit], forward[hit]
        if not len(g):
            continue
        # The words of the last period before g, nearest first: the run starts after the first that differs.
        reach = np.minimum(p, g - first[g])
        owner = np.repeat(np.arange(len(g)), reach)
        back = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
        differs = np.flatnonzero(ids[g[owner] - back] != ids[g[owner] - back + p[owner]])
        before = reach.copy()
        np.minimum.at(before, owner[differs], back[differs] - 1)
        start, end = g - before, g + p + forward
        whole = (before < p) & (end - start >= np.maximum(least_length, least_exponent * p))
        found.append(np.column_stack([start, end, p])[whole])
    every = np.vstack(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), dtype=bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[smallest]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _searched(texts: list[list[bytes]], least_length: int, least_exponent: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """For each list of words its runs as (start, length, period) and the words that are kept, joined."""
    index: dict[bytes, int] = {}
    sizes = np.array([len(one) for one in texts], dtype=np.int64)
    known = [[index.setdefault(word, len(index)) for word in one] for one in texts]
    ids = np.concatenate([np.array([*one, len(index) + at], dtype=np.int64) for at, one in enumerate(known)])
    starts, ends, periods = runs_of(ids, sizes, least_length, least_exponent)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, ends, -1)
    kept = np.cumsum(change)[:-1] == 0
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    bounds = np.searchsorted(starts, np.append(offsets, len(ids)))
    for at, one in enumerate(texts):
        low, high, offset = bounds[at], bounds[at + 1], offsets[at]
        runs = list(zip((starts[low:high] - offset).tolist(), (ends - starts)[low:high].tolist(), periods[low:high].tolist(), strict=True))
        left = [one[i] for i in np.flatnonzero(kept[offset : offset + len(one)])] if runs else one
        yield runs, b" ".join(left).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of words (cut at ASCII white space) with smallest period
    p, of ``least_length`` words and ``least_exponent`` periods (3 or more) at
    least, that no neighbouring word extends. ``collapsed`` joins by one space
    the words that no run holds beyond its first period. Whole texts; null and
    empty ones have no words and no runs. Repeated rows give equal rows, rows
    without doc_id keep their null, extra columns of any name are left out.
    Rows are worked off where they are read, without a shuffle; memory follows
    the longest text.
    """
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, texts, held = [], [], 0
                while at < batch.num_rows and held < GROUP_WORDS:
                    text = batch.column(1)[at].as_py() or ""
                    ids.append(batch.column(0)[at].as_py())
                    texts.append(text.encode("utf-8", "surrogatepass").split())
                    held += len(texts[-1]) + 1
                    at += 1
                runs, collapsed = zip(*_searched(texts, least_length, least_exponent), strict=True)
                fields = ("start", "length", "period")
                arrays = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(one) for one in texts], pa.int64()),
                    pa.array([[dict(zip(fields, run, strict=True)) for run in one] for one in runs], kind),
                    pa.array(collapsed, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of the contract, those of every tenth id made periodic from some word on.

    Rows without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    n, g = words(F.col("text")), F.floor(h / 10).cast("long")
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    start = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - start) / (3 + g % 8)).cast("long")
    chosen = F.when((h % 10 == 0) & (n > 0), F.struct(found.alias("words"), start.alias("a"), period.alias("p")))
    place = lambda i: F.when(i < F.col("chosen.a"), i).otherwise(F.col("chosen.a") + (i - F.col("chosen.a")) % F.col("chosen.p"))
    every = F.sequence(F.lit(0).cast("long"), F.size("chosen.words") - 1)
    made = F.array_join(F.transform(every, lambda i: F.get("chosen.words", place(i).cast("int"))), " ")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), chosen.alias("chosen")).select(
        "doc_id", F.when(F.col("chosen").isNotNull(), made).otherwise(F.col("text")).alias("text")
    )


def _strongest(runs: Column) -> Column:
    """The run of greatest length by period, compared as whole numbers; the earlier of equal ones."""
    return F.aggregate(
        runs,
        F.lit(None).cast(RUNS.elementType),
        lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(load(spark, sf_dir, "documents"))).withColumn("best", _strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """Runs from equal neighbours among factors of 1, 2, 4, ... words instead of extensions.

    Inside a run of smallest period p a factor of p words or more recurs first
    after p words; so at the factor length from p to under 2p, places whose
    next equal factor is p words on stand in a row from the start of the run.
    """
    sizes = [1 << level for level in range(20)]
    factors = ["f0 AS (SELECT doc_id, i, n, hash(w) AS h FROM w)"]
    for level, size in enumerate(sizes[1:], 1):
        # A factor needs its words inside the document, and four periods of at least half its length around it.
        factors.append(
            f"f{level} AS (SELECT doc_id, i, n, hash(h, later) AS h FROM (SELECT *, lead(h, {size // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS later"
            f" FROM f{level - 1}) WHERE later IS NOT NULL AND n >= {4 * (size // 2 + 1)})"
        )
    steps = " UNION ALL ".join(
        f"SELECT doc_id, i, {size} AS size, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS p FROM f{level}" for level, size in enumerate(sizes)
    )
    return rf"""
    WITH d0 AS (
        SELECT doc_id, {crc32_sql("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM documents
    ), d1 AS (
        SELECT *, len(own) AS n, h // 10 AS g, CASE WHEN len(own) > 0 THEN (h // 10) % len(own) END AS a FROM d0
    ), d AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
            list_transform(range(0, n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE own END AS words
        FROM d1
    ), w AS (
        SELECT doc_id, n, unnest(words) AS w, unnest(range(0, n)) AS i FROM d
    ), {", ".join(factors)}, s AS (
        SELECT * FROM ({steps}) WHERE p <= size AND 2 * p > size
    ), r AS (
        SELECT doc_id, min(i) AS start, max(i) + p + size - min(i) AS length, p AS period
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, size, p ORDER BY i) AS island FROM s)
        GROUP BY doc_id, size, p, island HAVING max(i) + p + size - min(i) >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * p)
    ), k AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w
        WHERE (doc_id, i) NOT IN (SELECT doc_id, unnest(range(start + period, start + length)) FROM r) GROUP BY doc_id
    ), b AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
               min_by({{'s': start, 'l': length, 'p': period}}, {{'e': -length / period, 's': start, 'p': period}}) AS best
        FROM r GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
           1000 * best.l // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
    """
