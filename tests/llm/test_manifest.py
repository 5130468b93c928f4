"""Merkle manifests against a plain tree."""

import hashlib

from pyspark.sql import functions as F

from frames import odd_docs
from typeloom.llm import merkle
from typeloom.llm.common import ranked


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def expected(rows):
    """rows: (id, source, leaf, other); sorted result rows as the manifest's columns."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] or ""))
        trees[name] = levels_of([r[2] for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (row_id, _, leaf, other) in enumerate(groups[name]):
            path = siblings(trees[name], i) + siblings(top, k)
            x = other or leaf
            for before, after in path:
                x = h("".join(before) + x + "".join(after))
            proof = "".join("".join(a + b) for a, b in path)
            out.append((row_id, leaf, trees[name][-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, source string, leaf string, other string")
    got = merkle.manifest(df, "id", "source", "leaf", "other").withColumn("proof", F.lower(F.hex("proof")))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def leaves(sizes):
    rows = []
    for name, size in sizes:
        for i in range(size):
            leaf = h(f"{name} {i}")
            rows.append((7 * i % size, name, leaf, h("bad") if i % 5 == 0 else leaf if i % 2 else None))
    return rows


def test_manifest_equals_a_plain_tree(spark):
    rows = leaves([(None, 4), ("", 1), ("é", 2), ("z", 3), ("hot", 1000), ("a", 244), ("b", 243), ("c", 82)])
    assert manifest_rows(spark, rows) == expected(rows)


def test_ancestors_are_joined_in_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHARED", 1)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = leaves([("hot", 700), ("a", 10), ("b", 1)])
    assert manifest_rows(spark, rows) == expected(rows)


def test_one_leaf_is_its_root(spark):
    leaf = h("x")
    assert manifest_rows(spark, [(1, None, leaf, None)]) == [(1, leaf, leaf, leaf, "", leaf, True)]


def test_no_leaf(spark):
    assert manifest_rows(spark, []) == []


def test_repeated_ids_and_rows_are_leaves_of_their_own(spark):
    one, two = h("1"), h("2")
    rows = [(1, "a", two, None), (1, "a", one, None), (1, "a", one, None), (None, "a", one, h("3")), (2, None, one, one)]
    got = manifest_rows(spark, rows)
    assert got == expected(rows)
    assert sum(not r[-1] for r in got) == 1


def test_leaf_digests_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = docs.select("doc_id", "text", merkle.digest_of(docs.doc_id, docs.text).alias("h")).collect()
    for row in got:
        fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.text)]
        assert row.h == h("".join(fields))
    leaves = docs.withColumn("leaf", merkle.digest_of(docs.doc_id, docs.text))
    proven = merkle.manifest(leaves, "doc_id", "row", "leaf")
    assert proven.count() == len(got) and proven.filter("verified").count() == len(got)


def test_ranks(spark, tmp_path):
    rows = [(g, (i * 37) % 101, i) for g, n in (("a", 101), ("b", 1), ("c", 60)) for i in range(n)]
    rows.append(("b", None, 0))
    df = spark.createDataFrame(rows, "g string, k long, u long")
    got = {(r.g, r.k, r.u): (r["rank"], r["size"]) for r in ranked(df, ["g"], ["k", "u"], f"{tmp_path}/r").collect()}
    assert len(got) == len(rows)
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r] for r in own] == [(i, len(own)) for i in range(len(own))]
