"""Web archives by round trip, near-duplicates by brute force, the pipeline."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from frames import ODD, odd_docs, rows_of
from typeloom.functions.sizing import work_folder
from typeloom.llm import bagminhash as B
from typeloom.llm import warc

TRAP = "\x1f\x08 WARC/1.1 "


def pages(spark):
    draw = random.Random(1)
    noise = "".join(chr(draw.randint(32, 0x2FF)) for _ in range(6000))
    rows = [(i, f"http://x/{i}\r\nInjected: 1", t) for i, t in enumerate([None, "", "short", "short", TRAP * 200, noise])]
    rows += [(10 + i, None, "same text " * 150) for i in range(30)] + [(39, "u", "same text " * 150), (None, "u", "same text " * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' as id", "'x' as payload", "'x' as salt", "'x' as original")


def expected(rows):
    top = {}
    for r in rows:
        if r["page_id"] is not None:
            top[r["html"]] = max(top.get(r["html"], -1), r["page_id"])
    for r in rows:
        data = (r["html"] or "").encode()
        other = len(data) >= 1000 and top.get(r["html"]) != r["page_id"]
        yield (
            "" if r["page_id"] is None else str(r["page_id"]),
            len(data),
            hashlib.sha1(data).hexdigest(),
            "revisit" if other else "response",
            str(top[r["html"]]) if other else None,
            None if other else data,
            True,
        )


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_archives_come_back(spark, tmp_path, split):
    df = pages(spark)
    warc.write_warc(df.repartition(2), f"{tmp_path}/warc")
    back = warc.read_warc(spark, f"{tmp_path}/warc", split)
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in back.select(
        "id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "intact").collect()]
    assert sorted(got, key=repr) == sorted(expected(df.collect()), key=repr)
    # other readers of gzip see the same records
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\n") == df.count() and b"\r\nInjected" not in raw


def test_false_magic_is_no_record(spark, tmp_path):
    inner = warc.member("7", "u", b"x", 1, hashlib.sha1(b"x").hexdigest(), None)
    outer = gzip.compress(b"WARC/1.1\r\nnot whole")[:-5]
    (tmp_path / "a.warc.gz").write_bytes(outer + b"\x1f\x8b\x08" + inner + b"\x1f\x8b")
    for split in (5, 64, 4096):
        assert [r["id"] for r in warc.read_warc(spark, str(tmp_path), split).collect()] == ["7"]


def test_no_pages_no_records(spark, tmp_path):
    warc.write_warc(pages(spark).limit(0), f"{tmp_path}/warc")
    assert warc.read_warc(spark, f"{tmp_path}/warc").count() == 0


def bag(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_classes(rows):
    bags = [(i, bag(t or "")) for i, t in rows if i is not None]
    above = {i: i for i, _ in bags}

    def top(x):
        return x if above[x] == x else top(above[x])

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b:
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    low, high = sorted((top(i), top(j)))
                    above[high] = low
    return {i: top(i) for i, _ in bags}


def copies(n=150, seed=5):
    """Texts with exact copies, a cloud of near copies about the threshold, a chain, repetitions."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for _ in range(draw.randint(0, 5)):
            text[draw.randint(0, 119)] = draw.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(n, n + 40):
        rows.append((i, " ".join(draw.choice(words) for _ in range(60))))
    rows += [(500, "go " * 400), (501, "go " * 390), (502, "go " * 200), (503, "A b"), (504, "a  B"), (505, None), (506, "")]
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = copies()
    found = B.near_duplicates(odd_docs(spark, [*rows, (None, "a b"), (503, "a b")]))
    got = {r["doc_id"]: r["class_id"] for r in found.collect() if r["doc_id"] is not None}
    assert got == brute_classes(rows)
    one = {r["doc_id"]: r for r in found.collect()}
    assert one[503]["n_copies"] == 3 and one[None]["class_id"] is None and one[505]["n_class"] == 1
    assert found.count() == len(rows) + 2


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 8)
    rows = copies(60, 9)
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(odd_docs(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_signatures_agree_as_bags_do():
    random_ = np.random.default_rng(0)
    for n, most in ((30, 3), (8, 40), (3, 900)):
        h = np.sort(random_.integers(0, 2**63, n, dtype=np.uint64))
        a = random_.integers(1, most, n)
        b = np.where(random_.random(n) < 0.6, a, random_.integers(1, 2 * most, n))
        s = B.bag_min_hash(np.repeat([0, 1], n), np.tile(h, 2), np.concatenate([a, b]), 2, 4096)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.035
        assert abs(B.overlap((h, a), (h, b)) - want) < 1e-12
        assert abs(B.overlaps([(h, a)], [(h, b)])[0, 0] - want) < 1e-6


def test_one_of_each_class_stays(spark):
    rows = copies(40)
    docs = odd_docs(spark, [*rows, *rows[:3], (None, "x y")])
    left = B.drop_near_duplicates(docs)
    classes = set(brute_classes(rows).values())
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted([*classes, None], key=repr)
    assert left.columns == docs.columns
    assert B.drop_near_duplicates(odd_docs(spark, ODD)).count() == 8
    assert B.near_duplicates(odd_docs(spark, [])).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    items = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    words = " ".join(f"plain{i}" for i in range(70))
    other = " ".join(f"other{i}" for i in range(70))
    rows = [(1, f"{words}."), (2, f"{words}."), (3, f"{other} {' '.join(f'item{i}' for i in range(12))} a@b.co end."), (4, "# # #"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source", "length(text) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
        assert at.columns == docs.columns
    assert sorted(kept["quality_rules"]) == [1, 2, 3] and sorted(kept["near_dedup"]) == [1, 3]
    assert "item5" not in kept["decontamination"][3] and kept["pii"] == {1: f"{words}.", 3: f"{other}  [EMAIL] end."}
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 2


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
