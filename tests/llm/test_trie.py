"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scanledger.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as the contract says, from a dictionary of prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), key, (role, text)))
    turns = {c: [t for _, _, t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        made[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        yield node
        for child in children.get(node, []):
            yield from below(child)

    out = set()
    for node, members in nodes.items():
        ends = sorted(c for c in members if made[c] == list(node))
        tree = list(below(node))
        out.add((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])),
            sum(n not in children for n in tree), sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in tree if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def found(spark, rows, container_turns):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in ("head", "path", "n", "id", "size", "turns")})
    lists = trie.stored(trie.rebuilt(trie.sequences(frame)), "lists")
    nodes = trie.prefix_trie(lists, container_turns).join(trie.endings(lists), "ending", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    got = [tuple(r) for r in nodes.select(*columns, F.coalesce("ends_sha256", F.lit(trie.NO_ENDS))).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    made = []
    for c in range(-30, 330):
        for t in range(rnd.choice([0, 1, 3, 8, 20])):
            made.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "čćé", None])))
    made += [(900 + c, t, "user", "same") for c in range(60) for t in range(6)]  # copies
    made += [(2000 + c, t, "user", "chain") for c in range(30) for t in range(c)]  # each goes on from the one before
    made += made[:5] + [(None, 0, "user", "x"), (None, None, None, None)]
    return made


@pytest.mark.parametrize("container_turns", [1 << 14, 40, 1])
def test_nodes(spark, rows, container_turns):
    assert found(spark, rows, container_turns) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, [(None, 1, "a", "b")], 10) == set()


def test_turnless_conversations_end_at_the_root(spark):
    one = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(one, 0, "user", "gone")]  # all its turns lie within its first h, and its base is absent
    assert found(spark, rows, 10) == brute(rows)
    assert len(brute(rows)) == 1


def test_a_very_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in (0, 300) for t in range(3000)]
    assert found(spark, rows, 100) == brute_long(rows)


def brute_long(rows):
    """Both conversations are one path of 3,000 turns, copies of each other."""
    sizes = [len(f"t{t}") for t in range(3000)]
    out = set()
    for d in range(3001):
        ends = hashlib.sha256(b"0,300" if d == 3000 else b"").hexdigest()
        out.add((0, d, 0 if d else None, 2, int(d < 3000), 1, sum(sizes[max(d - 1, 0) :]), ends))
    return out
