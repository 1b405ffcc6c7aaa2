"""The registered queries against their SQL twins, and every pipeline stage against brute force."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanledger.llm import lines, mixing, packing, quality
from scanledger.llm.common import packed, unpacked
from scanledger.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_DIR

WORDS = "the quick brown fox jumps over a lazy dog near some old river bank while many people watch it go by".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF_DIR}/{file}'")
    yield connection
    connection.close()


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sql):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    answer = sql.execute(ORACLE[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    assert in_order(tuple(r) for r in result.select(columns).collect()) == in_order(expected)


def test_working_names_of_packed_frames(spark):
    frame = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, row long, `x.y` long")
    back = packed(frame, "text", doc_id=F.lit(9), text=F.col("text")).select(*unpacked(frame.columns, text=F.upper("text")))
    assert back.columns == frame.columns and tuple(back.first()) == (1, "A", 2, 3)
    assert tuple(packed(frame.select("text"), "text", text=F.col("text")).select(*unpacked(["text"], text=F.col("text"))).first()) == ("a",)


# --- pipeline stages -------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """200 good and 100 junk documents with repeated lines, exact and near copies; and their labels."""
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))
    long = say(40)
    texts = []
    for i in range(200):
        own = "\n".join(say(rnd.randint(8, 30)) for _ in range(rnd.randint(1, 4)))
        texts.append(rnd.choice(["", "Read more\n", long + "\n", long.replace(long.split()[3], "other") + "\n"]) + own)
    for i in range(20):
        texts.append(texts[i])
        near = texts[i + 40].split(" ")
        near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    for _ in range(10):  # near copies whose lines are further apart than line dedup looks
        words = say(100).split()
        texts.append(" ".join(words))
        for at in (20, 50, 80):
            words[at] = "changed"
        texts.append(" ".join(words))
    texts += ["$$$ " + "".join(rnd.choice("#@!?%0123456789") for _ in range(300)) for _ in range(100)] + [None, "", "  "]
    sources = [rnd.choice(["web", "books", "code", None]) for _ in texts]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    labels = [(i, int(i < 260), 0) for i in range(len(rows)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """The rows that go into and come out of every stage."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, corpus).write.parquet(out)
        done = spark.read.parquet(out)
        found[name] = (docs.collect(), done.collect(), done.columns)
        docs = done
    return found


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert list(stages) == ["quality", "lines", "near_dedup", "mixing", "packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(stages[name][2] == columns for name in list(stages)[:-1])


def test_quality_stage(spark, corpus, stages):
    given, kept, _ = stages["quality"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    scores = model.score(quality.features([r.text for r in given]))
    assert {r.doc_id for r in kept} == {r.doc_id for r, s in zip(given, scores, strict=True) if s >= 0.5}
    held = {r.doc_id for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect() if r.h}
    right = [(s >= 0.5) == (r.doc_id < 260) for r, s in zip(given, scores, strict=True) if r.doc_id in held and r.text and r.text.strip()]
    assert np.mean(right) > 0.95 and len(right) > 80


def one_edit(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < 8 or min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_stage(stages):
    given, kept, _ = stages["lines"]
    earlier, want = [], {}
    for row in sorted(given, key=lambda r: r.doc_id):
        if row.text is None:
            want[row.doc_id] = None
            continue
        left, gone = [], False
        for line in row.text.split("\n"):
            words = line.lower().split()
            if words and any(one_edit(words, other) for other in earlier):
                gone = True
            else:
                left.append(line)
            if words:
                earlier.append(words)
        text = "\n".join(left)
        if not gone or text.strip(" "):
            want[row.doc_id] = text
    assert {r.doc_id: r.text for r in kept} == want
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    assert len(want) < len(given)


def test_near_dedup_stage(stages):
    given, kept, _ = stages["near_dedup"]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))

    sets = {r.doc_id: shingles(r.text) for r in given}
    part = {doc: doc for doc in sets}

    def root(doc):
        while part[doc] != doc:
            doc = part[doc]
        return doc

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert {r.doc_id for r in kept} == {doc for doc in sets if root(doc) == doc}
    assert len(kept) < len(given)


def test_mixing_stage(spark, stages):
    given, made, _ = stages["mixing"]
    size = {r.doc_id: len((r.text or "").split()) for r in given}
    copies = Counter(r.doc_id for r in made)
    texts = {r.doc_id: r for r in given}
    assert all(r == texts[r.doc_id] for r in made) and max(copies.values()) <= 2
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in given:
        sizes[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for row in mixing.source_targets(frame).collect():
        assert abs(taken[row.source] - row.target) <= largest[row.source]


def test_packing_stage(stages):
    from tokenizers import Tokenizer
    import public_tokenizers

    given, pieces, _ = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter()
    for r in given:
        tokens[r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1] += 1
    held = Counter()
    for r in pieces:
        held[r.doc_id, r.doc_tokens] += r.length
    assert {k: n * k[1] for k, n in tokens.items()} == dict(held)
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_goes_through_all_stages(spark, corpus, stages):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = corpus_pipeline.run(spark, corpus).collect()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "stage-mixing" in left and not left & {"stage-quality", "stage-lines", "stage-near_dedup", "lines", "sketches", "mix"}
    assert Counter((r.doc_id, r.start, r.length) for r in found) == Counter((r.doc_id, r.start, r.length) for r in stages["packing"][1])


# --- names of columns, contracts ----------------------------------------------------------


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "Mr John Smith\nwrote to a.b@example.com", "s"), (2, "Mr John Smith\nwrote again", "s"), (None, "x y", None), (2, "z", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["_gone", "_id", "_doc", "_parts", "_key", "_size", "_turn", "_copy", "copies", "_gaps", "_made", "_row", "_text", "_at", "_local", "_slice",
             "row", "doc", "parts", "key", "size", "hash", "at", "place", "tie", "copy", "id", "lang", "a.b", "count"]
    return frame.withColumns({name: F.lit(f"own {name}") for name in names if name != "a.b"}).withColumn("a.b", F.lit("own a.b"))


def test_columns_of_any_name_come_through(spark, clashing):
    from scanledger.llm import minhash, pii

    for made in (
        mixing.mixed_documents(clashing), pii.replace(clashing), lines.dedup_lines(clashing),
        minhash.without_near_duplicates(clashing), quality.scored(clashing, None),
    ):
        rows = made.collect()
        assert rows and all(row[name] == f"own {name}" for row in rows for name in clashing.columns[3:])


def test_ids_are_those_of_the_json_vocabulary(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "\n\n \t", "é é 中文 \U0001f600", "it's we'll I'M", "<|endoftext|> x", "a" * 5000, "1234567 89", "​\x00 end "]
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + odd
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {}
    for r in sorted(packing.token_pieces(frame).collect(), key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    for doc, text in enumerate(texts):
        assert ids[doc] == [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]
