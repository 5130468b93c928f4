import itertools
import math

import pytest
from pyspark.sql import functions as F

from helpers import clusters, nodes
from typeloom.functions.hashing import code32_of
from typeloom.operators.cluster import (
    cluster_kmeans,
    cluster_lsh,
    cluster_minhash,
    cluster_property_sets,
    cluster_summary,
    distance_moments,
    distance_stats,
    lsh_params,
    minhash_params,
)
from typeloom.operators.encode import assemble, feature_rows, vocabulary
from typeloom.operators.patterns import node_patterns, node_truth_counts, patterns_of_truth, presence


def patterns(spark, rows):
    return clusters(spark, [("", *r) for r in rows]).drop("cluster_id")


BASIC = [("A", ["p", "q"], 3), ("A", ["p"], 2), ("B", ["r"], 4), ("", ["p", "q"], 1)]


def test_patterns_and_presence(spark):
    n = nodes(
        spark,
        [("1", ["B", "A"], {"p": "1"}), ("2", ["A", "B"], {"p": "2", "q": None}), ("3", [], {})],
    )
    rows = {(r["label_key"], tuple(r["prop_set"])): r["n"] for r in node_patterns(n).collect()}
    assert rows == {("A:B", ("p",)): 2, ("", ()): 1}
    again = patterns_of_truth(node_truth_counts(n))
    assert again.exceptAll(node_patterns(n)).count() == 0
    bits = {r["node_id"]: (r["prop_p"], r["prop_q"]) for r in presence(n, ["q", "p"]).collect()}
    assert bits == {"1": (1.0, 0.0), "2": (1.0, 0.0), "3": (0.0, 0.0)}


def test_distance_stats_of_a_small_table_are_exact(spark):
    def code(label):
        return [code32_of(f"42|{i}|{label}") % 200001 - 100000 for i in range(5)]

    elements = [(code(label), set(names)) for label, names, n in BASIC for _ in range(n)]
    found = []
    for (c1, s1), (c2, s2) in itertools.combinations(elements, 2):
        d = math.sqrt(sum((x - y) ** 2 for x, y in zip(c1, c2)) / 1e12 + len(s1 ^ s2))
        if d > 0:
            found.append(d)
    row = distance_stats(patterns(spark, BASIC)).first()
    mean = sum(found) / len(found)
    assert row["n_pairs"] == len(found)
    assert row["avg_distance"] == pytest.approx(mean, abs=1e-6)
    assert row["min_distance"] == pytest.approx(min(found), abs=1e-6)
    assert row["max_distance"] == pytest.approx(max(found), abs=1e-6)
    deviation = math.sqrt(sum((d - mean) ** 2 for d in found) / (len(found) - 1))
    assert row["stddev_distance"] == pytest.approx(deviation, abs=1e-6)


def test_distance_moments_are_those_of_all_pairs(spark):
    def code(label):
        return [code32_of(f"42|{i}|{label}") % 200001 - 100000 for i in range(5)]

    elements = [(code(label), set(names)) for label, names, n in BASIC for _ in range(n)]
    squares = [
        sum((x - y) ** 2 for x, y in zip(c1, c2)) / 1e12 + len(s1 ^ s2)
        for (c1, s1), (c2, s2) in itertools.combinations(elements, 2)
        if (c1, s1) != (c2, s2)
    ]
    row = distance_moments(patterns(spark, BASIC)).first()
    assert row["n_pairs"] == len(squares)
    assert row["mean_square"] == pytest.approx(sum(squares) / len(squares), abs=1e-6)
    assert row["rms_distance"] == pytest.approx(math.sqrt(sum(squares) / len(squares)), abs=1e-6)
    huge = [("A", ["p"], 10**9), ("B", ["q"], 10**9)]
    assert distance_moments(patterns(spark, huge)).first()["n_pairs"] == 1e18
    alike = distance_moments(patterns(spark, [("A", ["p"], 5)])).first()
    assert (alike["n_pairs"], alike["mean_square"]) == (0, None)
    assert lsh_params(patterns(spark, [("A", ["p"], 5)]), exact=True).first()["bucket"] == 0.2


def test_vocabulary_and_feature_rows(spark):
    names = [f"n{i:03d}" for i in range(120)]
    p = patterns(spark, [("A", names, 1), ("", names[50:52], 2), ("B", [], 1)])
    assert {r["name"]: r["idx"] for r in vocabulary(p).collect()} == {x: i for i, x in enumerate(names)}
    rows = feature_rows(p)
    bits = {r["pattern_id"]: r["n"] for r in rows.filter("idx >= 5").groupBy("pattern_id").agg(F.count("*").alias("n")).collect()}
    assert bits == {"p0": 120, "p1": 2}
    vectors = {r["pattern_id"]: r["features"] for r in assemble(p).collect()}
    assert {v.size for v in vectors.values()} == {125}
    for r in rows.collect():
        assert vectors[r["pattern_id"]][r["idx"]] == r["value"]
    assert vectors["p1"].toArray()[5:].nonzero()[0].tolist() == [50, 51]


def test_distance_sample_is_bounded_and_fair(spark):
    big = patterns(spark, [("A", ["p"], 60_000_000), ("B", ["p", "q", "r"], 30_000_000)])
    row = distance_stats(big).first()
    # unequal neighbours in random order: 2 * 2/3 * 1/3 of the pairs
    assert 0.40 < row["n_pairs"] / 10_000 < 0.49


def test_parameters(spark):
    few = patterns(spark, [("A", ["p"], 900_000), ("B", ["q"], 900_000)])
    row = lsh_params(few).first()
    avg = distance_stats(few).first()["avg_distance"]
    assert row["tables"] == 37 and row["bucket"] == pytest.approx(avg * 1.2 * 0.8, abs=1e-6)
    assert minhash_params(few).first()["tables"] == 50
    one = lsh_params(patterns(spark, [("A", ["p"], 5)])).first()
    assert (one["bucket"], one["tables"]) == (0.2, 15)
    many = patterns(spark, [(f"L{i}", ["p"], 10) for i in range(12)])
    assert minhash_params(many).first()["tables"] == 25


def partition(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster_id"], []).append(r["pattern_id"])
    return sorted(map(sorted, found.values()))


def expected_partition(bucket, tables):
    names = sorted({x for _, props, _ in BASIC for x in props})

    def hashes(label, props):
        out = []
        for t in range(tables):
            emb = [code32_of(f"42|E|{t}|{i}") % 2001 - 1000 for i in range(5)]
            bit = {x: code32_of(f"42|P|{t}|{x}") % 2001 - 1000 for x in names}
            codes = [code32_of(f"42|{i}|{label}") % 200001 - 100000 for i in range(5)]
            length = math.sqrt(sum(c * c for c in emb) + sum(c * c for c in bit.values()))
            width = max(1, round(length * bucket * 1_000_000))
            total = sum(a * x for a, x in zip(emb, codes)) + 1_000_000 * sum(bit[x] for x in props)
            out.append(total // width)
        return tuple(out)

    found = {}
    for i, (label, props, _) in enumerate(BASIC):
        found.setdefault(hashes(label, props), []).append(f"p{i}")
    return sorted(found.values())


@pytest.mark.parametrize("tables", [1, 3, 15])
@pytest.mark.parametrize("bucket", [0.001, 0.7, 2.0, 1e6])
def test_lsh_floors_projections(spark, bucket, tables):
    rows = cluster_lsh(patterns(spark, BASIC), bucket, tables).collect()
    assert partition(rows) == expected_partition(bucket, tables)


def test_ml_lsh_is_repeatable(spark):
    p = patterns(spark, BASIC)
    assert partition(cluster_lsh(p, 1e-3, 15, impl="ml").collect()) == [["p0"], ["p1"], ["p2"], ["p3"]]
    first = partition(cluster_lsh(p, 0.7, 3, impl="ml").collect())
    assert first == partition(cluster_lsh(p, 0.7, 3, impl="ml").collect())


@pytest.mark.parametrize("impl", ["hash", "ml"])
def test_minhash(spark, impl):
    p = patterns(spark, BASIC + [("", [], 1)])
    rows = cluster_minhash(p, 25, impl=impl).collect()
    assert len(rows) == 5
    assert len({r["cluster_id"] for r in rows}) == 5
    assert sum(r["n"] for r in rows) == 11


def test_kmeans_with_fewer_patterns_than_clusters(spark):
    p = patterns(spark, BASIC)
    rows = cluster_kmeans(p).collect()
    assert sorted(r["pattern_id"] for r in rows) == ["p0", "p1", "p2", "p3"]
    assert len({r["cluster_id"] for r in cluster_kmeans(p, k=2).collect()}) == 2


def test_assembled_vectors(spark):
    p = patterns(spark, BASIC)
    for mode in ("hash", "word2vec"):
        rows = {r["pattern_id"]: r["features"].toArray() for r in assemble(p, mode).collect()}
        assert list(rows["p0"][5:]) == [1, 1, 0] and list(rows["p2"][5:]) == [0, 0, 1]
        assert all(abs(x) <= 0.1 for x in rows["p0"][:5])
        assert list(rows["p0"][:5]) == list(rows["p1"][:5]) != list(rows["p2"][:5])


def test_summary(spark):
    c = clusters(spark, [("c1", "A", ["p", "q"], 3), ("c1", "", ["p"], 2), ("c2", "B", [], 1)])
    rows = {r["cluster_id"]: r for r in cluster_summary(c).collect()}
    assert rows["c1"]["label_keys"] == ["", "A"] and rows["c1"]["n"] == 5
    assert [tuple(x) for x in rows["c1"]["props"]] == [("p", 5), ("q", 3)]
    assert rows["c2"]["props"] == []
    assert cluster_property_sets(c).count() == 3
    assert cluster_property_sets(c).agg(F.sum("n")).first()[0] == 6


def test_integer_kmeans_is_lloyd(spark):
    """The same rounds in plain Python, on dense vectors."""
    import hashlib

    from typeloom.operators.lloyd import integer_kmeans, sparse_rows

    rows = [("A" * (i % 3), [c for j, c in enumerate("pqrstu") if i >> j & 1], 1 + i * i % 7) for i in range(40)]
    p = patterns(spark, rows)
    vectors, weights = {}, {}
    for r in sparse_rows(p).collect():
        vectors.setdefault(r.pattern_id, {})[r.dim] = r.x
        weights[r.pattern_id] = r.n
    order = sorted(vectors, key=lambda i: (hashlib.md5(f"1|{i}".encode()).hexdigest(), i))
    centres = {c: vectors[i] for c, i in enumerate(order[:4])}

    def nearest():
        def far(v, c):
            return sum((v.get(d, 0) - c.get(d, 0)) ** 2 for d in v.keys() | c.keys())

        return {i: min(centres, key=lambda c: (far(v, centres[c]), c)) for i, v in vectors.items()}

    for _ in range(6):
        at = nearest()
        centres = {}
        for c in sorted(set(at.values())):
            own = [i for i in at if at[i] == c]
            dims = {d for i in own for d in vectors[i]}
            size = sum(weights[i] for i in own)
            centres[c] = {d: sum(weights[i] * vectors[i].get(d, 0) for i in own) // size for d in dims}
    got = {r.pattern_id: r.cluster_id for r in integer_kmeans(p, k=4).collect()}
    assert got == {i: f"cluster_{c}" for i, c in nearest().items()}
    assert len(set(got.values())) > 2
