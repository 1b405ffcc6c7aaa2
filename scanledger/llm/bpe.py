"""BPE encoding by content-defined chunks that documents share, and decoding (operator 12)."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, stored

LEAST, USUAL_BITS, MOST = 128, 9, 4096  # bytes of a chunk; a cut is expected every 2 ** USUAL_BITS
MARK_BITS = 26  # the marks of repeated chunks take 2 ** MARK_BITS bits, whatever the number of chunks
HOT_SHARE = 1000  # chunks that make up more than 1 / HOT_SHARE of all repeats are looked up by broadcast
MEMO_WORDS = 300_000
ROWS = 256

PART = "array<struct<pos:int,h1:long,h2:long,head:string,ids:binary,tail:string>>"
TEXT = "array<struct<h1:long,h2:long,text:string>>"


def default_vocabulary() -> str:
    """The public lower-casing BPE vocabulary with word ends and 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each UTF-8 text end: after places whose rolling hash over 32 bytes has leading zeros.

    A place is passed over if the chunk would be under LEAST bytes, and one of
    MOST bytes ends anyhow; never inside a character. An edit moves the cuts of
    its neighbourhood only. The texts are hashed in one go: a chunk is longer
    than the window, so no text looks into the one before it.
    """
    data = b"".join(texts)
    rolling = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        rolling[shift:] = rolling[shift:] + (rolling[:-shift] << np.uint32(shift))
    places = np.flatnonzero(rolling >> np.uint32(32 - USUAL_BITS) == 0) + 1
    bounds = np.cumsum([0, *map(len, texts)])
    first = np.searchsorted(places, bounds, side="right").tolist()
    found = []
    for text, start, low, high in zip(texts, bounds[:-1].tolist(), first[:-1], first[1:], strict=True):
        ends, last, n = [], 0, len(text)
        for place in [*(places[low:high] - start).tolist(), n]:
            while place - last > MOST:
                last = _boundary(text, last + MOST)
                ends.append(last)
            place = _boundary(text, place)
            if place - last >= LEAST or (place == n and place > last):
                ends.append(place)
                last = place
        found.append(ends)
    return found


def _boundary(data: bytes, place: int) -> int:
    while place < len(data) and data[place] & 0xC0 == 0x80:
        place += 1
    return place


def _chunks(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The chunks of each text, and the 128-bit hashes of all of them as rows of two signed longs."""
    import xxhash

    chunks = [[text[a:b] for a, b in zip([0, *ends], ends, strict=False)] for text, ends in zip(texts, cuts(texts), strict=True)]
    digests = b"".join([xxhash.xxh3_128_digest(chunk) for one in chunks for chunk in one])
    return chunks, np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    mask = np.int64((1 << bits) - 1)
    return np.stack([h1 & mask, h2 & mask])


class Encoder:
    """Ids of texts that begin and end at white space or at the ends of a document.

    ASCII white space is dropped by the vocabulary's own splitting and no
    normalisation reaches across it, so words between white space are encoded
    apart; those seen lately are remembered.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[bytes, bytes] = {}
        self.names: list[str] | None = None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [text.split() for text in texts]
        self._learn({word for one in cut for word in one})
        return [b"".join(map(self.memo.__getitem__, one)) for one in cut]

    def _learn(self, words: set[bytes]) -> None:
        """Remember the ids of these words; of others those seen lately, up to a bound."""
        missing = [word for word in words if word not in self.memo]
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo = {word: self.memo[word] for word in words if word in self.memo}
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            # One text of many words costs far less than as many texts; tokens are dealt back by where they begin.
            texts = [word.decode("utf-8") for word in some]
            code = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(code.ids, dtype=self.kind)
            begins = np.cumsum([0, *[len(text) + 1 for text in texts]])
            starts = np.fromiter((start for start, _ in code.offsets), dtype=np.int64, count=len(ids))
            bounds = np.searchsorted(starts, begins)
            self.memo.update((word, ids[low:high].tobytes()) for word, low, high in zip(some, bounds[:-1], bounds[1:], strict=True))

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.kind).astype(np.int32)

    def rows(self, doc_ids: pa.Array, packed: list[bytes], with_decoded: bool) -> pa.RecordBatch:
        """doc_id, ids and, if asked for, what the ids decode to."""
        ids = [self.ids(one) for one in packed]
        arrays = [doc_ids, pa.array(ids, pa.list_(pa.int32()))]
        if with_decoded:
            arrays.append(pa.array([self.decode(one.tolist()) for one in ids], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    def decode(self, ids: list[int]) -> str:
        """The text that the library makes of ids, special tokens kept."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        # Without a decoder tokens are joined by spaces, which a table does faster.
        if self.names is None:
            self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return " ".join(map(self.names.__getitem__, ids))


def _encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process: later tasks go on with its vocabulary and the words it remembers."""
    state = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(state, "vocabulary", None) != vocabulary:
        state.encoder, state.vocabulary = Encoder(vocabulary), vocabulary
    return state.encoder


def split_ends(text: bytes) -> tuple[bytes, bytes | None, bytes]:
    """(head, middle, tail): what lies before the first and after the last ASCII white space.

    The ids of the middle do not depend on the neighbours. A text without white
    space is all head.
    """
    if len(text.split(None, 1)) == 1 and not text[:1].isspace() and not text[-1:].isspace() or not text:
        return text, None, b""
    head = b"" if text[:1].isspace() else text.split(None, 1)[0]
    tail = b"" if text[-1:].isspace() else text.rsplit(None, 1)[-1]
    return head, text[len(head) : len(text) - len(tail)], tail


def joined(parts: list[tuple[bytes, bytes | None, bytes]]) -> Iterator[tuple[bool, bytes]]:
    """(is text, bytes): packed ids of middles and, between them, the texts to encode again.

    A join is widened on both sides to the next white space, over whole chunks
    if they have none; there its ids and those of the chunks agree.
    """
    open_text: list[bytes] = []
    for head, middle, tail in parts:
        open_text.append(head)
        if middle is not None:
            yield True, b"".join(open_text)
            yield False, middle
            open_text = [tail]
    yield True, b"".join(open_text)


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(text or "").encode("utf-8") for text in column.to_pylist()]


def _repeated(texts: DataFrame) -> DataFrame:
    """(h1, h2, n) of the chunks that occur twice or more in all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found, n = np.unique(_chunks(_bytes(batch.column(1)))[1], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n)], ["h1", "h2", "n"])

    counted = texts.mapInArrow(count, "h1 long, h2 long, n long")
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1")


def _marks(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit field with two places set per repeated chunk: as many bytes at any size of the corpus.

    More chunks than it can tell apart make more documents go the way of
    repeated chunks; results stay the same.
    """
    mask = F.lit((1 << bits) - 1)
    places = repeated.select(F.explode(F.array(F.col("h1").bitwiseAND(mask), F.col("h2").bitwiseAND(mask))).alias("place"))
    word = F.shiftright("place", 6).alias("word")
    # At most 2 ** (bits - 6) rows of two longs.
    rows = places.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    field = np.zeros(1 << (bits - 6), dtype=np.int64)
    field[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return field


def _marked(texts: list[bytes], field: np.ndarray, bits: int) -> list[tuple[list[bytes], list[list[int]], list[bool]]]:
    """Per text its chunks, their hashes, and which of them are marked."""
    chunks, hashes = _chunks(texts)
    places = _places(hashes[:, 0], hashes[:, 1], bits)
    marks = (((field[places >> 6] >> (places & 63)) & 1) == 1).all(axis=0).tolist()
    hashes, at, found = hashes.tolist(), 0, []
    for one in chunks:
        found.append((one, hashes[at : at + len(one)], marks[at : at + len(one)]))
        at += len(one)
    return found


def encoded(
    docs: DataFrame,
    vocabulary: str | None = None,
    with_decoded: bool = False,
    mark_bits: int = MARK_BITS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the tokenizers library gives them without special tokens.

    ``with_decoded`` adds what they decode to, by the same task.

    Chunks with content-defined ends that occur twice or more in the corpus are
    encoded once; documents refer to them. What lies between them is encoded
    where it is read, and so are documents without such chunks. Joins are
    encoded again up to the next white space on both sides, where the ids of
    both sides agree. Null and empty texts have no ids; repeated rows give equal
    rows, a null doc_id stays; extra columns of any name are left out.

    Only repeated chunks, references to them and documents that hold some are
    shuffled. Chunks that many documents hold are few and joined by broadcast,
    so no key gathers rows in one task. Memory follows the longest text.
    """
    vocabulary = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = stored(_repeated(texts), "chunk-counts")
    field = texts.sparkSession.sparkContext.broadcast(_marks(repeated, mark_bits))
    ids_schema = "doc_id long, ids array<int>" + (", decoded string" if with_decoded else "")

    def alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in _batches(batches):
            texts = _bytes(batch.column(1))
            marked = _marked(texts, field.value, mark_bits)
            kept = [(i, text) for i, text, (_, _, marks) in zip(batch.column(0).to_pylist(), texts, marked, strict=True) if not any(marks)]
            yield encoder.rows(pa.array([i for i, _ in kept], pa.int64()), encoder.encode([data for _, data in kept]), with_decoded)

    part_type = pa.struct([("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string())])
    text_type = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("text", pa.string())])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        seen: set[tuple[int, int]] = set()
        for batch in _batches(batches):
            doc_ids, parts, new, own = [], [], [], []
            marked = _marked(_bytes(batch.column(1)), field.value, mark_bits)
            for doc_id, (chunks, hashes_of, marks) in zip(batch.column(0).to_pylist(), marked, strict=True):
                if not any(marks):
                    continue
                mine, added, stretch = [], [], []
                for chunk, hashes, is_known in zip([*chunks, b""], [*map(tuple, hashes_of), (0, 0)], [*marks, True], strict=True):
                    if not is_known:
                        stretch.append(chunk)
                        continue
                    if stretch:
                        head, middle, tail = split_ends(b"".join(stretch))
                        part = {"pos": len(mine), "head": head, "tail": tail, "ids": None}
                        if middle is not None:
                            own.append((part, middle))
                        mine.append(part)
                        stretch = []
                    if chunk:
                        mine.append({"pos": len(mine), "h1": hashes[0], "h2": hashes[1]})
                        if hashes not in seen:
                            seen.add(hashes)
                            added.append({"h1": hashes[0], "h2": hashes[1], "text": chunk})
                doc_ids.append(doc_id)
                parts.append(mine)
                new.append(added)
            for (part, _), ids in zip(own, encoder.encode([middle for _, middle in own]), strict=True):
                part["ids"] = ids
            arrays = [pa.array(doc_ids, pa.int64()), pa.array(parts, pa.list_(part_type)), pa.array(new, pa.list_(text_type))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "parts", "texts"])

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in _batches(batches):
            ends = [split_ends(text) for text in _bytes(batch.column(2))]
            middles = iter(encoder.encode([middle for _, middle, _ in ends if middle is not None]))
            ids = [None if middle is None else next(middles) for _, middle, _ in ends]
            arrays = [pa.array([h for h, _, _ in ends], pa.binary()).cast(pa.string()), pa.array(ids, pa.binary()), pa.array([t for _, _, t in ends], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["h1", "h2", "head", "ids", "tail"])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in _batches(batches):
            runs = []
            for parts in batch.column(1).to_pylist():
                ends = [((p["head"] or "").encode(), p["ids"], (p["tail"] or "").encode()) for p in sorted(parts, key=lambda p: p["pos"])]
                runs.append(list(joined(ends)))
            again = iter(encoder.encode([piece for run in runs for is_text, piece in run if is_text]))
            ids = [b"".join(next(again) if is_text else piece for is_text, piece in run) for run in runs]
            yield encoder.rows(batch.column(0), ids, with_decoded)

    marked_docs = texts.mapInArrow(shared, f"doc_id long, parts {PART}, texts {TEXT}").withColumn("key", F.monotonically_increasing_id())
    marked_docs = stored(marked_docs, "chunk-parts")
    codes = marked_docs.select(F.inline("texts")).dropDuplicates(["h1", "h2"]).select("h1", "h2", "text")
    codes = stored(codes.mapInArrow(code, "h1 long, h2 long, head string, ids binary, tail string"), "chunk-codes")

    parts = marked_docs.select("key", "doc_id", F.inline("parts"))
    own = parts.filter("h1 IS NULL").select("key", "doc_id", "pos", "head", "ids", "tail")
    references = parts.filter("h1 IS NOT NULL").select("key", "doc_id", "pos", "h1", "h2")
    # At most hot_share chunks hold more than one in hot_share of the repeats each, and none is over MOST bytes.
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.filter(F.col("n") * hot_share > total).select("h1", "h2")
    frequent = references.join(F.broadcast(codes.join(F.broadcast(hot), ["h1", "h2"], "left_semi")), ["h1", "h2"])
    others = references.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(codes, ["h1", "h2"])
    every = own.unionByName(frequent.drop("h1", "h2")).unionByName(others.drop("h1", "h2"))
    whole = every.groupBy("key", "doc_id").agg(F.collect_list(F.struct("pos", "head", "ids", "tail")).alias("parts"))
    return texts.mapInArrow(alone, ids_schema).unionByName(whole.select("doc_id", "parts").mapInArrow(assemble, ids_schema))


def decoded(frame: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the text the tokenizers library makes of each row's ids, special tokens kept.

    Null ids are an empty list. Extra columns are left out.
    """
    vocabulary = vocabulary or default_vocabulary()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in _batches(batches):
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return frame.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(load(spark, sf_dir, "documents"), with_decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
