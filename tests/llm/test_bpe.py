"""Chunked encoding against the tokenizers library on whole texts."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanledger.llm import bpe

PIECES = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "'s", "'", "7", "!?",
          "<|endoftext|>", "<|start", "oftext|>", "ß", "Σ", "İ", "中", "\u0000", "x" * 50, "가", "‍"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_vocabulary())


@given(st.lists(st.sampled_from(PIECES), max_size=40), st.lists(st.integers(0, 400), max_size=6))
@settings(max_examples=300, deadline=None)
def test_joins_of_any_cuts(library, encoder, pieces, places):
    text = "".join(pieces)
    data = text.encode()
    ends = sorted({bpe._boundary(data, min(p, len(data))) for p in places} | {0, len(data)})
    parts = [bpe.split_ends(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    found = b"".join(encoder.encode([piece])[0] for _, piece in bpe.joined(parts))
    assert encoder.ids(found).tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=[chr(c) for c in range(0, 128)], max_size=60))
@settings(max_examples=400, deadline=None)
def test_ascii_words(library, encoder, text):
    assert encoder.ids(encoder.encode([text.encode()])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdeéß中") for _ in range(rnd.randint(1, 9))) for _ in range(8000)).encode()
    ends = bpe.cuts([text])[0]
    assert bpe.cuts([b"x" * 700, text, b"", text[:50], text])[1::3] == [ends, ends]
    assert ends[-1] == len(text) and b"".join(text[a:b] for a, b in zip([0, *ends], ends, strict=False)) == text
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert all(bpe.LEAST <= n <= bpe.MOST + 3 for n in sizes[:-1])
    for end in ends:
        text[:end].decode()
    moved = b"some words before " + text[:20_000] + b" an edit " + text[20_000:]
    [old, new], hashes = bpe._chunks([text, moved])
    assert sum(chunk in set(new) for chunk in old) > 0.9 * len(old) and len(hashes) == len(old) + len(new)
    assert bpe.cuts([b""]) == [[]] and bpe.cuts([]) == [] and max(map(len, bpe._chunks([b"x" * 50_000])[0][0])) <= bpe.MOST


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 8))) for _ in range(n))
    shared = [say(300) for _ in range(4)]
    texts = [None, "", " \n", "one", "x" * 100_000, say(3000) + "\n" + shared[0], shared[0] + " tail", shared[0], shared[0].upper()]
    texts += [say(rnd.randint(0, 300)) + rnd.choice(["", " ", "-"]) + rnd.choice(shared) + rnd.choice(["", "!", " "]) + say(20) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, shared[1]), (None, None)]
    extra = {name: F.lit("z") for name in ("key", "ids", "parts", "h1", "pos", "head", "n")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


@pytest.mark.parametrize("mark_bits, hot_share", [(26, 1000), (10, 3), (6, 100_000)])
def test_whole_texts(docs, library, mark_bits, hot_share):
    """Also with marks that take most chunks for repeated ones, and with every chunk or none looked up by broadcast."""
    one_pass = mark_bits > 10
    found = bpe.encoded(docs, with_decoded=one_pass, mark_bits=mark_bits, hot_share=hot_share)
    found = (found if one_pass else bpe.decoded(found)).collect()
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


def test_chunks_that_documents_share_are_found(docs):
    counted = bpe._repeated(docs.select("doc_id", "text")).agg(F.count("*"), F.sum("n")).first()
    assert counted[0] > 0 and counted[1] > 3 * counted[0]


def test_no_rows(docs):
    assert bpe.decoded(bpe.encoded(docs.filter("false"))).count() == 0
    assert bpe.encoded(docs.filter("doc_id = 3")).first().ids is not None
