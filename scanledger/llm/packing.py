"""Packing token sequences shortest-pack-first over the length histogram (operator 8)."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, numbered, stored

LENGTH = 1024
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def default_ranks() -> str:
    """The public byte-level BPE vocabulary with 50,257 ids, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_pieces(
    docs: DataFrame,
    ranks_path: str | None = None,
    pattern: str | None = None,
    length: int = LENGTH,
    with_ids: bool = True,
    with_crc: bool = False,
) -> DataFrame:
    """Cut every document's ids, an end id added, into pieces of at most ``length``.

    (doc_id, start, length, doc_tokens) and, as asked, ``ids`` array<int> and
    ``ids_crc32``. The vocabulary is named by path; ids are those of the
    byte-level tokenizer of that vocabulary, the end-of-text string being its
    own id. A null or empty text is the end id alone. Documents are encoded
    one by one, so memory follows the longest document, not the partition.
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    fields = [*PIECES.fields]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if with_crc:
        fields.append(T.StructField("ids_crc32", T.LongType()))
    schema = T.StructType(fields)

    def cut(batches: Iterable[pa.RecordBatch]):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: dict[str, list] = {field.name: [] for field in fields}
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = np.array([*encoder.encode(text or "", allowed_special="all"), END_ID], dtype="<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["length"].append(len(piece))
                        out["doc_tokens"].append(len(ids))
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32))
                        if with_crc:
                            out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                kinds = {"ids": pa.list_(pa.int32())}
                arrays = [pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()]
                yield pa.RecordBatch.from_arrays(arrays, [*out])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (how many sequences, the lengths in each), covering the histogram.

    Lengths are placed longest first into the open pattern with the most room
    that still holds them, so counts of whole patterns move at once and the work
    depends on the number of lengths, never on the number of documents.
    """
    room: dict[int, Counter[tuple[int, ...]]] = {}  # room left: patterns, and how many sequences have each

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            room.setdefault(space, Counter())[pattern] += count

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            most = max(room, default=0)
            if most < size:
                # None is short enough: open sequences and fill each with this length before the next.
                each = length // size
                whole, rest = divmod(left, each)
                put(length - size * each, (size,) * each, whole)
                put(length - size * rest, (size,) * rest, min(rest, 1))
                break
            pattern, count = room[most].popitem()
            if not room[most]:
                del room[most]
            used = min(count, left)
            put(most, pattern, count - used)
            put(most - size, (*pattern, size), used)
            left -= used
    return [(count, pattern) for pattern, count in sorted((p, c) for held in room.values() for p, c in held.items())]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Where ranks of a length go: (length, first rank, ranks, first sequence, offset)."""
    ranks: Counter[int] = Counter()
    found, sequence = [], 0
    for count, pattern in plan:
        offset = 0
        for size in pattern:
            found.append((size, ranks[size], count, sequence, offset))
            ranks[size] += count
            offset += size
        sequence += count
    return found


SLOTS = "_size long, _rank long, _count long, _sequence long, _offset long"


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Give every piece a sequence: all its columns, ``sequence_id`` and ``offset``.

    Needs doc_id, start and length (1 to ``length``). Lengths are counted; the
    packing of the counts (at most ``length`` numbers, whatever the number of
    documents) is planned on the driver; pieces, numbered by range within their
    length, look up their place by rank. Pieces alike in all three columns
    (repeated rows) come in any order. No rows give no rows.
    """
    spark = pieces.sparkSession
    keys = [F.col("length"), F.col("doc_id"), F.col("start")]
    placed = numbered(pieces, keys, "_place")
    # One row per length: bounded by the length of a sequence.
    counts = {row["length"]: row["n"] for row in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, before = [], 0
    for size in sorted(counts):
        first.append((size, before))
        before += counts[size]
    plan = spark.createDataFrame(slots(patterns(counts, length)), SLOTS)
    firsts = spark.createDataFrame(first, "_size long, _first long")
    # A length has one slot per pattern that holds it: their number does not grow with the documents.
    places = plan.join(firsts, "_size").select(
        F.col("_size"), (F.col("_first") + F.col("_rank")).alias("_from"), "_count", "_sequence", "_offset"
    )
    step = F.col("_place") - F.col("_from")
    return placed.join(
        F.broadcast(places), (F.col("length") == F.col("_size")) & (step >= 0) & (step < F.col("_count"))
    ).select(*pieces.columns, (F.col("_sequence") + step).alias("sequence_id"), F.col("_offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, at most a sequence's length in all."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda part: part["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, length: int = LENGTH, **vocabulary) -> DataFrame:
    """Documents to pieces with their sequence, token ids as a checksum."""
    pieces = stored(token_pieces(docs, length=length, with_ids=False, with_crc=True, **vocabulary), "pieces")
    return pack(pieces, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
