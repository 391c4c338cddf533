"""The trie against a plain walk over all prefixes of all conversations."""

import hashlib
import random
import zlib

import pytest

from tuneloom.llm import prefixes

SHAPE = "conv_id bigint, turn bigint, role string, text string, pos int, `key.x` string"


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    convs = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        convs.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(p) == len(path) + 1 for p in below), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, block=4):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE).repartition(3)
    return sorted((tuple(r) for r in prefixes.prefix_trie(frame, block).collect()), key=str)


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 40), 100, 101, 205, 207, 1000, 1001]:
        shared = rng.randrange(3)
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            text = f"opening {t}" if shared and t < 6 else rng.choice(["ja", "nein", f"süß {c} {t}"])
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 3), (3, 1)])
def test_random_dialogues(spark, seed, block):
    rows = dialogues(seed)
    assert run(spark, rows, block) == plain(rows)


def test_nulls_ties_repeats(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, "a", "tie"), (0, 1, "a", "tie"),
            (0, 2, "", ""), (7, 1, "user", "x"), (7, 1, "user", "x"), (None, 1, "user", "lost"),
            (300, 0, "user", "long " * 4000), (512, 3, "a", "b"), (513, 3, "a", "b"),
            (1024, 5, "a", "b"), (5000, None, None, None)]
    assert run(spark, rows) == plain(rows)


def test_role_and_text_do_not_run_together(spark):
    rows = [(c, t, "ab" if c == 0 else "a", "c" if c == 0 else "bc") for c in (0, 1000) for t in range(7)]
    assert run(spark, rows) == plain(rows)


def test_one_conversation_holds_most_turns(spark):
    rows = [(100, t, "user", f"t{t}") for t in range(700)] + [(103, 0, "user", "t0"), (2, 0, "x", "y")]
    assert run(spark, rows) == plain(rows)


def test_many_end_at_one_node(spark):
    rows = [(c * 100, 0, "user", "same") for c in range(1500)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
