"""Prefix tries of conversations against a plain trie."""

import hashlib
import random
import zlib

from typeloom.llm import prefix_trie as trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort(key=lambda t: (*t[:2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    members, ended = {}, {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        path = tuple(t[2:] for t in turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
        ended.setdefault(path, []).append(conv)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(path, [])]
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        totals[path] = (sum(b[0] for b in below) + own, sum(b[1] for b in below) or 1)
    out = []
    for path, convs in members.items():
        ids = ",".join(map(str, sorted(ended.get(path, []))))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            len(kids.get(path, [])), totals[path][1], totals[path][0], hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as k1", "1 as depth", "2 as conv", "3 as rank")
    return sorted((tuple(r) for r in trie.prefix_trie(df).select(COLUMNS).collect()), key=repr)


def drawn(seed, convs, longest, words):
    draw = random.Random(seed)
    return [
        (conv, turn, draw.choice("ua"), draw.choice(words))
        for conv in convs
        for turn in range(draw.randint(1, longest))
    ]


def test_trie_equals_a_plain_trie(spark):
    rows = drawn(1, [*range(0, 60), *range(200, 230), *range(301, 320), -5, -100], 9, ["x", "yé", "z" * 50])
    rows += [(201, t, "u", f"turn {t}") for t in range(20, 90)]  # a long chain
    rows += [(c, t, "u", "same") for c in range(400, 440) for t in range(7)]  # a group of copies
    assert found(spark, rows) == expected(rows)


def test_copies_of_rows_change_nothing(spark, monkeypatch):
    for name, value in (("SHARED", 3), ("STRETCH", 4), ("ID_CHARS", 5)):
        monkeypatch.setattr(trie, name, value)
    rows = drawn(2, [*range(0, 40), *range(100, 120)], 4, ["x", "y"])
    rows += [(7, t, "u", f"turn {t % 5}") for t in range(30, 70)]
    rows += [(c, t, "u", "same") for c in range(500, 530) for t in range(9)]
    assert found(spark, rows) == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, "u", "first"), (1, 0, None, "a"), (1, 0, None, "a"), (1, 0, "u", None), (1, 0, "", ""),
        (None, 1, "u", "nobody's"), (0, 3, "u", ""), (0, None, None, None), (150, 1, "u", "b"), (151, 1, "u", "b"),
    ]
    assert found(spark, rows) == expected(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # No conversation 100 gives turns, and the own one lies within the replaced head.
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 2)
    rows = [(conv, 0, "u", "x")]
    assert found(spark, rows) == expected(rows)
    assert len(expected(rows)) == 1


def test_no_turn(spark):
    assert found(spark, []) == []
