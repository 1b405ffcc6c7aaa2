"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanledger.llm import chat, graph, lines, minhash, mixing, multi_index, packing, pii, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        None,
        "",
        " \n\t ",
        "word",
        LINE,
        LINE + "\n" + LINE.replace("five", "FIVE!"),
        "token = abcdefABCDEF0123456789 mail a.b@example.com and 10.0.0.1",
        "x" * 200_000,
        "long words " * 30_000,
        LINE,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[4], (None, LINE, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    extra = {"key": F.lit("k"), "rep": F.lit(1), "size": F.lit(2), "score": F.lit(3.0), "entities": F.lit("e"), "removed": F.lit(0)}
    return frame.withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_mixing(docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == 12 and mixing.mix(none).count() == 0
    assert all(r.taken == r.copies * r.size and r.taken <= 2 * r.size for r in found)
    assert {r.size for r in found if r.doc_id in (0, 1, 2)} == {0}
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed_documents(docs).columns == docs.columns
    taken = sum(r.copies for r in found)
    assert mixing.mixed_documents(docs).count() == taken


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 1000)], "source string, source_size long")
    target = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a is full at 20; b (2), c (1) and null (5) share the rest, null is full at 2000.
    assert target["a"] == 20 and target[None] == 2000
    assert sum(target.values()) == pytest.approx(1.5 * 3010) and target["b"] == pytest.approx(2 * target["c"])


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, int(i != 7), 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scores = [r.score for r in quality.scored(docs, model).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    assert quality.train(none, labels) is None and quality.train(docs, labels.filter("false")) is None
    assert {r.score for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.scored(none, model).count() == 0


def test_rows_of_one_id_are_one_in_training(spark):
    frame = spark.createDataFrame([(1, f"text {i} " * i) for i in range(40)] + [(2, "one"), (3, "not chosen")], "doc_id long, text string")
    found = quality._features_of(frame, [1, 2])
    assert found.shape == (2, quality.N_FEATURES) and (found == quality._features_of(frame.repartition(7), [2, 1])).all()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_the_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(1)
    n = 6000
    good, bad = rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (n, 4))
    unlabelled = np.vstack([good[: int(n * prior)], bad[: n - int(n * prior)]])
    trusted = rng.normal(1.5, 1, (2000, 4))
    assert quality.estimated_prior(trusted, unlabelled) == pytest.approx(prior, abs=0.04)
    assert quality.estimated_prior(trusted[:1], unlabelled) == 0.5


def test_risk_never_turns_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (400, 2)), rng.normal(-2, 1, (400, 2))
    model = quality.fit(good[:200], np.vstack([good[200:], bad[:100]]), prior=2 / 3)
    assert (model.score(good) > 0.5).mean() > 0.85 and (model.score(bad[100:]) < 0.5).mean() > 0.85


def test_packing(docs, none):
    found = packing.pack_documents(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {r.doc_tokens for r in found if r.doc_id in (0, 1)} == {1}
    for pieces in by_sequence.values():
        place = 0
        for piece in sorted(pieces, key=lambda p: p.offset):
            assert piece.offset == place
            place += piece.length
        assert place <= 1024
    assert sum(r.length for r in found if r.doc_id == 8) == next(r.doc_tokens for r in found if r.doc_id == 8)
    assert packing.pack_documents(none).count() == 0


def test_sequences_give_the_ids_back(docs):
    pieces = packing.token_pieces(docs.filter("doc_id in (3, 4, 5, 6)").select("doc_id", "text"), with_ids=True, with_crc=True)
    packed = packing.pack(pieces)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert ids == r.ids and zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == r.ids_crc32


def test_shortest_pack_first_covers_the_histogram():
    histogram = {700: 5, 400: 3, 300: 10, 100: 7, 1: 2000, 1024: 2}
    plan = packing.patterns(histogram)
    assert all(sum(pattern) <= 1024 for _, pattern in plan)
    placed = {size: sum(count * pattern.count(size) for count, pattern in plan) for size in histogram}
    assert placed == histogram


def test_secrets(docs, none):
    found = {r.doc_id: r.found for r in secrets.scan(docs).collect()}
    assert secrets.scan(docs).count() == 12 and secrets.scan(none).count() == 0
    assert [(s.kind, s.start) for s in found[6]] == [(0, 0)] and found[0] == [] and found[7] == []


def test_many_secrets_in_one_text(spark):
    text = "é " + " ".join(f"token={i:014x}" for i in range(1500)) + " secret: x secret: abcdefghijkl"
    row = secrets.scan(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    kinds = [re.compile(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    least = (12, 18, 16)
    expected = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(text) if len(m.group(p.groups)) >= least[k])
    assert [(s.start, s.kind, s.end) for s in row.found if s.kind < 3] == expected


def test_time_follows_the_number_of_secrets(spark):
    import time

    text = " ".join(f"{i:020x}" for i in range(40_000))
    frame = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    began = time.monotonic()
    found = secrets.candidates(frame).first().spans
    assert time.monotonic() - began < 20  # ten seconds on a machine of its own
    assert [(s.start, s.end) for s in found if s.kind == 2] == [(21 * i, 21 * i + 20) for i in range(40_000)]


def test_owned_spans_and_counts_by_brute_force(spark):
    """Tokens of mixed case and digits: one owner's, shared ones, and one that lies in a base span."""
    draw = random.Random(9)
    token = lambda: "aA1" + "".join(draw.choice("abcdefABCDEF0123456789_") for _ in range(draw.randint(21, 30)))
    tokens = [token() for _ in range(12)]
    rows = []
    for doc in range(60):
        mine = [tokens[0] if doc % 20 == 0 else draw.choice(tokens[1:6] if doc % 3 else tokens[6:])] + (["password=" + tokens[11]] if doc % 7 == 0 else [])
        rows.append((doc, " and ".join(mine), draw.choice(["en", "de"]), f"s{doc % 5}" if doc % 20 else "s0"))
    places = {}
    for _, text, lang, source in rows:
        for m in re.finditer(r"[A-Za-z0-9_-]{24,}", text):
            value = m.group()
            if re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value):
                places.setdefault(value, []).append((source, f"{source}/{lang}"))
    want = {}
    for doc, text, _, _ in rows:
        base = [(m.start(), m.end()) for m in re.finditer(r"password=[A-Za-z0-9+/_.=-]+|[0-9a-f]{16,}", text)]
        for m in re.finditer(r"[A-Za-z0-9_-]{24,}", text):
            seen = places.get(m.group(), [])
            if len({o for o, _ in seen}) == 1 and not any(a < m.end() and m.start() < b for a, b in base):
                want.setdefault(doc, []).append((m.start(), m.end(), len(seen), len({r for _, r in seen}), 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: [(s.start, s.end, s.n_places, s.n_repositories, s.n_owners) for s in r.found if s.kind == 3] for r in secrets.scan(frame).collect()}
    assert {doc: spans for doc, spans in found.items() if spans} == want and want


def test_ownership_tells_examples_from_owned(spark):
    shared, own = "token=EXAMPLEkey1234567", "token=ownedSecret987654"
    rows = [(i, shared, "en", f"s{i}") for i in range(4)] + [(9, own, "en", "s9"), (10, own, "de", "s9")]
    found = {r.doc_id: r.found[0] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found[0].verdict == "example" and found[0].n_owners == 4
    assert found[9].verdict == "live" and (found[9].n_owners, found[9].n_repositories) == (1, 2)


def test_pii(docs, none, spark):
    done = pii.replace(docs)
    assert done.count() == 12 and pii.replace(none).count() == 0
    text = {r.doc_id: r.text for r in done.collect()}
    assert "a.b@example.com" not in text[6] and "10.0.0.1" not in text[6] and text[0] is None and text[8] == "long words " * 30_000
    many = [(i, f"10.0.0.{i % 250} a{i}@b.co (555) 123-{i:04d} or +1 555-123-{i:04d}") for i in range(700)]
    rows = pii.replace(spark.createDataFrame(many, "doc_id long, text string")).collect()
    made = {}
    for row in rows:
        for e in row.entities:
            shape = re.sub("[0-9]", "9", e.surrogate)
            assert e.type in ("email",) or shape == re.sub("[0-9]", "9", e.match) or e.type == "ip"
            key = re.sub(r"\D", "", e.match)[-10:] if e.type == "phone" else e.match
            value = re.sub(r"\D", "", e.surrogate)[-10:] if e.type == "phone" else e.surrogate
            assert made.setdefault((e.type, key), value) == value
    assert len(set(made.values())) == len(made)
    assert not {k for _, k in made} & set(made.values())


def test_surrogates_of_hard_forms(spark):
    """Names in part and in full, inner marks and capitals, titles, 15-digit cards, IPv6, long phone numbers."""
    texts = [
        "Mr John Smith met Mr Smith and Dr Jane Doe, then Prof. Dr. Doe.",
        "Mr O'Brien, Mr McDonald and Mr Anna-Lena Weiss; MR JOHN SMITH; Frau J. Weiss; Miss Mary K. Poe",
        "card 3782 822463 10005 or 378282246310005, host 2001:db8:0:1::7f and FE80::1A2B, at 12:30:45 a::b",
        "+49 301 2345 6789 012 and +1 555 123 4567 or (555) 123-4567, (0301) 234-5678",
    ]
    rows = {r.doc_id: r for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    made = {e.match: e.surrogate for r in rows.values() for e in r.entities}
    assert set(made) == {
        "Mr John Smith", "Mr Smith", "Dr Jane Doe", "Prof. Dr. Doe", "Mr O'Brien", "Mr McDonald", "Mr Anna-Lena Weiss", "MR JOHN SMITH", "Frau J. Weiss",
        "Miss Mary K. Poe", "3782 822463 10005", "378282246310005", "2001:db8:0:1::7f", "FE80::1A2B",
        "+49 301 2345 6789 012", "+1 555 123 4567", "(555) 123-4567", "(0301) 234-5678",
    }
    last = lambda match: made[match].split(" ")[-1]
    assert last("Mr John Smith") == last("Mr Smith") == last("MR JOHN SMITH").capitalize() and made["MR JOHN SMITH"] == made["Mr John Smith"].upper()
    assert last("Dr Jane Doe") == last("Prof. Dr. Doe") and made["Prof. Dr. Doe"].startswith("Prof. Dr. ")
    assert last("Mr Anna-Lena Weiss") == last("Frau J. Weiss") and re.fullmatch(r"Frau [A-Z]\. [A-Z][a-z]+", made["Frau J. Weiss"])
    assert re.fullmatch(r"Miss [A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+", made["Miss Mary K. Poe"])
    assert len({last(m) for m in ("Mr Smith", "Dr Jane Doe", "Mr O'Brien", "Mr McDonald", "Frau J. Weiss")}) == 5
    for match, surrogate in made.items():
        if not match[0].isalpha() or ":" in match:
            assert re.sub("[0-9a-f]", "9", surrogate.lower()) == re.sub("[0-9a-f]", "9", match.lower()) and surrogate != match
        else:
            assert not set(re.findall(r"[\w'-]{3,}", surrogate)) & {"John", "Smith", "Jane", "Doe", "O'Brien", "McDonald", "Anna-Lena", "Lena", "Weiss", "JOHN", "SMITH", "Mary", "Poe"}
    digits = lambda text: re.sub(r"\D", "", text)
    assert digits(made["3782 822463 10005"]) == made["378282246310005"] and made["378282246310005"].startswith("37")
    assert digits(made["+1 555 123 4567"])[-10:] == digits(made["(555) 123-4567"])
    assert made["+49 301 2345 6789 012"].startswith("+49 ") and sum(a != b for a, b in zip(digits(made["+49 301 2345 6789 012"])[2:], "30123456789012", strict=True)) > 8
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(made["378282246310005"]))))
    assert total % 10 == 0
    assert "12:30:45 a::b" in rows[2].text


def test_many_names_get_distinct_ones(spark):
    names = [("".join(chr(97 + (i // 26**k) % 26) for k in range(4))).capitalize() for i in range(400)]
    texts = [(i, f"Mr {names[i]} {names[-1 - i]} and Mr {names[-1 - i]} and Hugo") for i in range(400)] + [(400, "Mr Hugo Fabio")]
    found = pii.replace(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    family, given = {}, {}
    for row in found:
        for e in row.entities:
            old, new = e.match.split(" ")[1:], e.surrogate.split(" ")[1:]
            assert family.setdefault(old[-1], new[-1]) == new[-1]
            if len(old) > 1:
                assert given.setdefault(old[0], new[0]) == new[0]
    for made in (family, given):
        assert len(set(made.values())) == len(made) and not set(made) & set(made.values())


def test_lines(docs, none):
    done = lines.dedup_lines(docs)
    rows = {r.doc_id: r for r in done.collect()}
    assert done.count() == 12 and lines.dedup_lines(none).count() == 0
    assert rows[4].text == LINE and rows[5].text == "" and rows[5].removed == [0, 1] and rows[9].text == ""
    assert rows[None].text == LINE and rows[0].n_lines == 0 and rows[1].n_lines == 1


@pytest.mark.parametrize("other, near", [("one two three four five six seven eight nine", True), (LINE + " eleven", True), (LINE.replace("six", "6"), True), (LINE.replace("six seven", "6 7"), False), ("two one three four five six seven eight nine ten", False)])
def test_one_word_apart(spark, other, near):
    frame = spark.createDataFrame([(1, LINE), (2, other)], "doc_id long, text string")
    assert {r.doc_id for r in lines.repeated_lines(frame, broadcast_rows=0).collect()} == ({2} if near else set())


def test_short_lines_repeat_equal_ones(spark):
    rows = [(1, "Read more\n\none line\n}"), (2, "read  MORE\n\nread less\n" + LINE), (3, "one line\nread more\n}"), (4, "\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    assert text == {1: rows[0][1], 2: "\nread less\n" + LINE, 3: "", 4: "\n\n"}
    text = {r.doc_id: r.text for r in lines.dedup_lines(frame, shortest=lines.LEAST_WORDS).collect()}
    assert text == dict(rows)


def test_texts_of_repeated_short_lines_leave_the_pipeline(spark):
    frame = spark.createDataFrame([(1, "Read more\none line", "en", "s", 18), (2, "one line\nread more", "en", "s", 18)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.line_dedup(spark, frame, "").collect()] == [1]


def test_minhash(docs, none):
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs, words=2).collect()}
    assert minhash.near_duplicates(docs, words=2).count() == 12 and minhash.near_duplicates(none).count() == 0
    assert rows[9].component_id == 4 and not rows[9].kept and rows[4].kept and rows[None].kept
    assert all(rows[i].kept and rows[i].n_shingles == 0 for i in (0, 1, 2)) and rows[3].n_shingles == 1


def test_copies_go_whatever_their_ids(spark):
    """Repeated rows, texts of one id, null ids, near copies of them; texts without words stay."""
    near, other, third = " ".join(f"n{i}" for i in range(12)), "a b c d e f g", "h i j k l m n"
    rows = [(1, LINE), (1, LINE), (1, LINE), (2, other), (2, third), (3, third), (None, other), (None, LINE), (None, "p q r s"), (None, "P q r s"), (None, near)]
    rows += [(None, near + " twelve"), (None, ""), (None, None), (4, ""), (4, "")]
    left = minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")), words=2, percent=80)
    assert left.columns == ["doc_id", "text", "n_chars"]
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    # Of near copies without ids either may stay: the one whose text hash is smaller.
    kept = [text for doc, text in found if doc is None and text]
    assert len(kept) == 2 and {text.lower() for text in kept} <= {"p q r s", near, near + " twelve"} and "p q r s" in {text.lower() for text in kept}
    assert [row for row in found if row[0] is not None or not row[1]] == sorted([(1, LINE), (2, other), (2, third), (None, ""), (None, None), (4, ""), (4, "")], key=str)


def test_links_that_the_smallest_member_misses(spark):
    """A base among copies that are no links of each other: only the base joins them."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for doc in range(24):
        words = list(base)
        for at in rng.choice(200, 9, replace=False):
            words[at] = f"x{doc}_{at}"
        rows.append((doc, " ".join(words)))
    rows.insert(13, (100, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {doc: set(zip(t.split(), t.split()[1:], strict=False)) for doc, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = {doc: doc for doc in sets}
    for _ in sets:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, words=2).collect()} == part
    assert len(set(part.values())) < 25


def _vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300 + i, [x + 0.01 * i for x in rows[1][1]], 0) for i in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, [None] * 8, 0), (404, [1.0], 0), rows[3], (None, rows[2][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _usable(rows):
    kept = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and i not in (400, 401, 402, 403, 404)}
    return np.array(sorted(kept)), np.array([kept[i] for i in sorted(kept)])


def test_graph_search(spark):
    rows, table = _vectors(spark)
    ids, x = _usable(rows)
    queries = table.filter("vec_id in (0, 1, 50, 200, 400)").select("vec_id")
    found = {}
    for r in graph.nearest(table, queries, shard=64).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {0, 1, 50, 200}
    for query, answer in found.items():
        d = np.sqrt(((x - x[ids == query]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:10]
        assert [a[1] for a in sorted(answer)] == [ids[i] for i in order]
        assert [a[2] for a in sorted(answer)] == pytest.approx([d[i] for i in order], abs=1e-12)
    assert graph.nearest(table.filter("false"), queries).count() == 0
    assert graph.nearest(table.filter("vec_id < 3"), queries).count() == 4


def test_multi_index(spark):
    rows, table = _vectors(spark)
    ids, x = _usable(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    found = {r.vec_id: r for r in multi_index.near_vectors(table).collect()}
    assert len(found) == len({r[0] for r in rows})
    assert {i: found[i].n_links for i in ids} == dict(zip(ids.tolist(), (linked.sum(1) - 1).tolist(), strict=True))
    part = ids.copy()
    for _ in ids:
        part = np.where(linked, part[None, :], 10**9).min(1)
    assert {i: found[i].component_id for i in ids} == dict(zip(ids.tolist(), part.tolist(), strict=True))
    assert all(found[i].n_links == 0 and found[i].kept for i in (400, 401, 402, 403, 404, None))
    assert multi_index.near_vectors(table.filter("false")).count() == 0


def test_vectors_of_another_length_are_compared_among_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "k1": F.lit(1), "rep": F.lit(2)})
    links = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(table).collect()}
    assert all(links[100 + i] == (4, 100) for i in range(5))
    found = graph.nearest(table, table.filter("vec_id in (0, 100)").select("vec_id")).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 100] == [(100 + i, 0.0) for i in range(1, 5)]
    assert len([r for r in found if r.query_id == 0]) == 10


def test_double_vectors_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-9, 2.0, 3.0]) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.score for r in graph.nearest(table, table.filter("vec_id = 0").select("vec_id")).collect()}
    assert found == pytest.approx({i: i * 1e-9 for i in range(1, 6)}, rel=1e-6)


def test_visits_double_until_the_recall_is_met():
    rng = np.random.default_rng(6)
    sample = multi_index.unit_rows(rng.normal(size=(3000, 6)))
    few, all_ = multi_index.fit(sample, 200_000, 0.9, 0.9), multi_index.fit(sample, 200_000, 0.9, 1.1)
    assert few.recall >= 0.9 and few.visits < all_.visits == len(all_.first) * len(all_.second) and all_.recall == 1.0


def test_search_computes_far_fewer_distances_than_the_shard_has():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    made, entry = graph.build(x)
    queries = rng.normal(size=(100, 32)).astype(np.float32)
    found, _, path = graph.beam_search(x, made, entry, queries, 96)
    looked = [len(np.unique(made[p[p >= 0]])) for p in path]
    assert np.mean(looked) < 0.4 * len(x)
    want = np.argsort(((queries[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(w)) for f, w in zip(found, want, strict=True)]) >= 9.0


def test_tool_calls(spark):
    call = '{{"tool_call": {{"id": "{}", "name": "{}", "arguments": "{}", "after": [{}]}}}}'.format
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "assistant", call("b", "add", '{\\"y\\": 2, \\"x\\": 1}', '"a"')),
        (1, 2, "assistant", call("a", "add", '{\\"x\\": \\"one\\", \\"z\\": 3}', "")),
        (1, 3, "tool", '{"tool_call_id": "a", "content": "3"}'),
        (1, 4, "tool", '{"tool_call_id": "q", "content": null}'),
        (1, 5, "assistant", call("c", "none", "no json", '"d"')),
        (1, 6, "assistant", call("d", "add", "[1]", '"c"')),
        (1, 7, "assistant", call("a", "add", "{}", "")),
        (None, 0, "user", "hello"),
        (2, 0, "user", None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x"))
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", False), ("reply", "prompt", "string", True), ("reply", "turn", "integer", True)], "name string, parameter string, kind string, required boolean")
    found = {(r.conv_id, r.turn): r for r in chat.link(chat.messages(table), schemas).collect()}
    assert len(found) == len(rows)
    assert {t: found[1, t].status for t in range(8)} == {0: "message", 1: "unanswered", 2: "linked", 3: "linked", 4: "orphan", 5: "cyclic", 6: "cyclic", 7: "repeated"}
    assert found[1, 2].position < found[1, 3].position < found[1, 1].position < found[1, 5].position
    assert found[1, 1].json.startswith('{"arguments":{"x":1,"y":2},') and found[1, 1].problems == ""
    assert found[1, 2].problems == "wrong kind of x; unknown z" and found[1, 5].problems == "unknown tool"
    assert found[None, 0].status == "unplaced" and found[2, 0].problems == "missing prompt"
    assert chat.link(chat.messages(table.filter("false")), schemas).count() == 0




def test_call_levels_match_brute_force(spark):
    """Long chains, calls with several predecessors, unknown ones, and circles with calls behind them."""
    draw = random.Random(3)
    rows = [(9, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    rows += [(8, "a", ["b"]), (8, "b", ["a"]), (8, "d", ["a"]), (8, "e", ["d", "f"]), (8, "f", []), (8, "s", ["s"])]
    for conv in range(3):
        for i in range(40):
            after = [f"c{draw.randrange(max(0, i - 4), i)}" for _ in range(draw.choice([0, 1, 1, 1, 2, 3]))] if i else ["unknown"]
            rows.append((conv, f"c{i}", after + ([f"c{draw.randrange(40)}"] if conv == 2 and draw.random() < 0.1 else [])))
    ids = {(conv, call) for conv, call, _ in rows}
    before = {(conv, call): {(conv, b) for b in after} & ids for conv, call, after in rows}
    expected, grows = {}, True
    while grows:
        ready = {c: max((expected[b] + 1 for b in bs), default=0) for c, bs in before.items() if c not in expected and bs <= expected.keys()}
        expected.update(ready)
        grows = bool(ready)
    found = {(r.conv_id, r.call_id): r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()}
    assert found == {c: expected.get(c) for c in ids}
    assert expected[9, "c299"] == 299 and (8, "e") not in expected
