"""Toxicity, language model, url rules."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from frames import ODD, odd_docs, rows_of
from pyspark.sql import functions as F
from typeloom.llm import lm_scoring
from typeloom.llm import toxicity as T
from typeloom.llm import url_filters as U
from typeloom.llm.common import fold_of
from typeloom.llm.lm_scoring import (
    BLOCK,
    VOCABULARY,
    Attention,
    PairCounts,
    SubwordEncoder,
    lm_scores,
    windows,
)

RANKS = P.path("byte_bpe_50k.tiktoken")


def toxic_rows(n=300):
    draw = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(30)]
        bad = i % 3 == 0
        if bad:
            words[draw.randint(0, 29)] = draw.choice(["vile", "vilest"])
        if draw.random() < (0.7 if bad else 0.2):  # mentions go with the label, but are not toxic
            words[draw.randint(0, 29)] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_words_count_and_mentions_do_not(spark):
    rows, labels = toxic_rows()
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([*labels, (0, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    free = T.fit(docs, labels, penalty=0.0)
    held = T.fit(docs, labels, penalty=50.0)
    gap = lambda m: abs(m.score(["muslim"]) - m.score(["christian"]))
    assert gap(held) <= gap(free) and gap(held) < 0.05
    assert held.score(["vile", "word1"]) > 0.7 > 0.3 > held.score(["word1"])
    scored = T.toxicity(odd_docs(spark), held).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    for r in scored:
        texts = [t or "" for i, t in ODD if i == r["doc_id"]]
        assert any(math.isclose(r["score"], held.score(T.words_of(t)), abs_tol=1e-9) for t in texts)


def test_no_labels_no_weights(spark):
    model = T.fit(odd_docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.weights == {} and T.toxicity(odd_docs(spark, []), model).count() == 0


def test_swaps_exchange_one_group():
    pairs = list(T.swaps("Nothing here. Two women came.\nNo", T.IDENTITY_TERMS))
    assert pairs == [(["two", "women", "came"], ["two", "men", "came"])]


def brute_base(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
        for (i, _), h, ws in zip(rows, held, tokens, strict=True)
    ]


def test_base_scores(spark):
    rows = [*ODD, *((i, f"Word{i % 5} b\x0bC é{i} \u00a0 x") for i in range(10, 40))]
    scored = lm_scores(odd_docs(spark, rows).repartition(3), fold_of("doc_id", 7) == 2, RANKS)
    scored = scored.withColumn("base", F.round("base_score", 6)).cache()
    got = rows_of(scored, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    assert got == sorted(brute_base(rows), key=repr)
    assert all(r["score"] < 0 for r in scored.collect())
    assert lm_scores(odd_docs(spark, []), F.lit(False), RANKS).count() == 0


def test_a_chunk_has_no_more_documents_than_places(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_DOCS", 4)
    rows = [(i, f"word{i % 3} x{i} word1") for i in range(30)]
    docs = odd_docs(spark, rows).coalesce(1)
    parts = lm_scoring.tokenized(docs, F.lit(False), RANKS, "doc_id", "text").filter("word is null")
    sizes = parts.groupBy("chunk").agg(F.max("place").alias("last"), F.count("*").alias("n")).collect()
    assert all(r["n"] <= 4 and r["last"] == r["n"] - 1 for r in sizes) and sum(r["n"] for r in sizes) == 30
    scored = lm_scores(docs, fold_of("doc_id", 7) == 2, RANKS).withColumn("base", F.round("base_score", 6))
    got = rows_of(scored, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    assert got == sorted(brute_base(rows), key=repr)


def test_every_training_block_is_trained_on(spark, monkeypatch):
    weights = []
    average = lm_scoring._averaged
    monkeypatch.setattr(
        lm_scoring,
        "_averaged",
        lambda trained, shape: weights.extend(r["weight"] for r in trained.collect()) or average(trained, shape),
    )
    ids = [np.arange(n, dtype="<u2") % 300 for n in (0, 1, BLOCK - 1, BLOCK, 1000, 5000)]
    docs = spark.createDataFrame([(0, bytearray(i.tobytes())) for i in ids], "chunk long, ids binary")
    model = lm_scoring.train_model(docs.repartition(2), RANKS)
    assert sum(weights) == sum(len(i) // BLOCK + 1 for i in ids)
    assert np.isfinite(model.params["E"]).all() and np.abs(model.params["W"]).max() > 0


def test_rare_subwords_are_told_apart_and_the_window_is_wide(spark):
    assert BLOCK >= 16
    draw = np.random.default_rng(5)
    # more common subwords than leaves; two rarer ones of one leaf tell what comes two places later
    texts = [np.tile(np.arange(1000, 2100, dtype="<u2"), 30) for _ in range(34)]
    texts += [np.tile(np.array([7, 9], "<u2"), 500)]
    for i in range(2000):
        rare, after = ((40_000, 7), (40_001, 9))[i % 2]
        texts.append(np.array([*draw.integers(100, 110, 3), rare, 50, after], "<u2"))
    docs = spark.createDataFrame([(0, bytearray(i.tobytes())) for i in texts], "chunk long, ids binary")
    model = lm_scoring.train_model(docs.coalesce(1), RANKS)
    leaf = model.vocabulary.leaf
    assert leaf[40_000] == leaf[40_001] and leaf[7] != leaf[9]
    attention = model.attention()

    def score(*ids):
        return model.scores(np.array(ids, "<u2"), np.array([len(ids)]), attention)[0]

    for rare, right, wrong in ((40_000, 7, 9), (40_001, 9, 7)):
        start = (101, 102, 103, rare, 50)
        gap = score(*start, right) - score(*start, wrong)
        assert gap > 0.1


def test_passes_go_on_and_long_ones_stay_finite():
    model, random_ = small_model(2)
    x = random_.integers(0, 50, (600, BLOCK)).astype(np.int32)
    blocks = (np.roll(x, 1, axis=0), x, np.roll(x, -1, axis=1), np.zeros(600, bool))
    start, _ = model.gradient(*blocks)
    for _ in range(3):
        model.train(*blocks)
    assert model.steps == 3 * math.ceil(600 / lm_scoring.BATCH)
    assert model.gradient(*blocks)[0] < start
    model.p["Wq"] *= 1e3  # scores far beyond what an exponential holds
    model._project()
    assert np.isfinite(model.log_probability(*blocks)).all()


def test_subwords_make_up_the_words():
    encoder = SubwordEncoder(RANKS)
    words = ["a", "ab\u00a0c", "é" * 9, "x\x85", "don't", "1234567", "中文"]
    words = [w.encode() for w in words]
    whole = encoder.encoding
    for word, ids in zip(words, encoder.encode(words), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode_ordinary(" " + word.decode())


def test_each_leaf_is_scored_once():
    rows = [np.arange(n) % 7 for n in (0, 1, BLOCK - 1, BLOCK, 40)]
    sizes = np.array([len(r) for r in rows])
    before, x, targets, first, row = windows(np.concatenate(rows), sizes, 9)
    for i, r in enumerate(rows):
        own = targets[row == i].reshape(-1)
        assert own[own >= 0].tolist() == [*r, 9]
        inputs = x[row == i].reshape(-1)[: len(r) + 1]
        assert inputs.tolist() == [9, *r] and first[row == i].tolist()[0]
        for k in np.flatnonzero(row == i)[1:]:
            assert before[k].tolist() == x[k - 1].tolist() and not first[k]
    some = np.array([0, 2, len(x) - 1])
    for a, b in zip(windows(np.concatenate(rows), sizes, 9, some), (before, x, targets, first, row), strict=True):
        real = np.ones(len(some), bool) if a.ndim == 1 or a is not before else ~first[some]
        assert a[real].tolist() == b[some][real].tolist() or a.shape == before[some].shape and (a[~first[some]] == b[some][~first[some]]).all()


def small_model(seed=0):
    random_ = np.random.default_rng(seed)
    model = Attention(Attention.initial(), PairCounts(random_.integers(0, 9, (VOCABULARY, VOCABULARY))))
    for k in model.p:
        model.p[k] = model.p[k].astype(float) + random_.normal(size=model.p[k].shape) * 0.1
    model._project()
    return model, random_


def test_probabilities_sum_to_one_and_see_no_future():
    model, random_ = small_model()
    x = random_.integers(0, VOCABULARY, (2, BLOCK))
    total = 0.0
    for t in range(VOCABULARY):
        targets = np.full((1, BLOCK), -1)
        targets[0, 5] = t
        total += math.exp(model.log_probability(x[:1], x[1:], targets, np.array([False])).sum())
    assert abs(total - 1) < 1e-5
    targets = random_.integers(0, VOCABULARY, (1, BLOCK))
    seen = model.log_probability(x[:1], x[1:], targets, np.array([False]))
    later = x.copy()
    later[1, 5:] = 3
    again = model.log_probability(later[:1], later[1:], targets, np.array([False]))
    assert np.allclose(seen[0, :5], again[0, :5]) and not np.allclose(seen[0, 5:], again[0, 5:])


def test_gradients():
    model, random_ = small_model(1)
    blocks = [random_.integers(0, VOCABULARY, (3, BLOCK)) for _ in range(3)]
    blocks[2][0, 4:] = -1
    first = np.array([True, False, False])
    loss, g = model.gradient(*blocks, first)
    for name, table in g.items():
        at = np.unravel_index(np.abs(table).argmax(), table.shape)
        model.p[name][at] += 1e-5
        model._project()
        assert abs((model.gradient(*blocks, first)[0] - loss) / 1e-5 - table[at]) < 1e-4, name
        model.p[name][at] -= 1e-5
        model._project()


URLS = ["http://A.example.NET/en/1", "https://x.org/fr/", "http://example.net", "nothing", None, "", "http://b.com/de/2?x=1",
        "http://m.example.com/de/a#b", "s://xnet/", "http://net/?q=/en/", "http://café.ORG/fr", "a://b?c/d://e"]
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        r for _, r in RULES
        if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])
    ]
    return host, path, max(fits, key=len, default=None)


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr(
        "*", "'x' as host", "'x' as path", "'x' as token", "'x' as row", "'x' as query"
    )


def test_given_rules(spark):
    frame = pages(spark, URLS).union(pages(spark, URLS))
    mined = U.mine(U.labelled(frame.select("page_id", "url"), RULES))
    got = rows_of(U.judge_urls(frame, RULES, mined), "page_id", "host", "path", "rule")
    assert got == sorted([(i, *brute_url(u)) for i, u in enumerate(URLS)] * 2, key=repr)


def test_mined_rules_match_as_plain_search(spark):
    draw = random.Random(3)
    urls = []
    for i in range(400):
        host = draw.choice(["casino-win", "news", "blog", "shop"])
        urls.append(f"http://{host}.site{draw.randint(0, 3)}.com/{draw.choice('ab')}/{i}?{draw.choice('xyz')}=1")
    frame = pages(spark, [*urls, None, "", "http://casino-win.site9.com/a"])
    mined = U.mine(U.labelled(frame.select("page_id", "url"), ()), min_count=3)
    rules = [(set(r["items"]), r["verdict"], r["confidence"]) for r in mined.collect()]
    assert {"h:casino-win"} in [items for items, _, _ in rules]
    assert not any(a < b and ca >= cb for a, _, ca in rules for b, _, cb in rules if len(b) - len(a) == 1)
    tokens = U.with_parts(frame.select("page_id", "url"))
    tokens = tokens.select("page_id", U.tokens(F.col("host"), F.col("path"), F.col("query")).alias("t"))
    want = {
        r["page_id"]: "block" if any(items <= set(r["t"]) for items, _, _ in rules) else "allow"
        for r in tokens.collect()
    }
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(frame, (), mined).collect()}
    assert got == want and got[402] == "block" and got[400] == "allow"


def test_rules_of_any_size_of_input_and_place_in_a_url(spark):
    # six blocked pages among 6,000 give a rule; so do late tokens of deep urls, and hosts without end
    deep = "/".join(f"{c}x" for c in "abcdefghijklmnopqrst")
    rows = [(["h:com", f"h:site{i % 97}", f"p:{i % 31}"], "allow") for i in range(6000)]
    rows += [(["h:com", "h:tail"], "block")] * 6
    rows += [([f"h:{x}" for x in deep.split("/")] + [late], label) for late, label in
             (("q:bad", "block"), ("q:good", "allow")) for _ in range(9)]
    rows += [(["h:com", f"h:bad{i}", "p:x"], "block") for i in range(2100) for _ in range(5)]
    labels = spark.createDataFrame(rows, "tokens array<string>, label string")
    mined = {" ".join(r["items"]): r for r in U.mine(labels).collect()}
    assert mined["h:tail"]["confidence"] == 1.0 and mined["q:bad"]["confidence"] == 1.0
    assert sum(k.startswith("h:bad") for k in mined) == 2100
    assert not any(k.count(" ") and "q:bad" in k for k in mined)
    frame = pages(spark, [f"http://bad{i}.com/x" for i in range(3)])
    strange = spark.createDataFrame(
        [(f"r{i}", [f"h:none{i}"], "block", 1.0, 0.1, f"h:none{i}") for i in range(2500)], U.EMPTY
    )
    late = spark.createDataFrame([("z", ["h:bad2"], "block", 0.9, 0.01, "h:bad0")], U.EMPTY)
    late = late.withColumn("token", F.lit("h:bad0")).withColumn("items", F.array(F.lit("h:bad0")))
    judged = U.judge_urls(frame.withColumn("url", F.regexp_replace("url", "bad[0-9]", "bad0")), (), strange.union(late))
    assert {r["verdict"] for r in judged.collect()} == {"block"}


def brute_rules(rows, min_count, confidence):
    """Rules of all token sets, by trying each; of tokens in the same urls the least is combined."""
    urls = {t: frozenset(i for i, (ts, _) in enumerate(rows) if t in ts) for t in {t for ts, _ in rows for t in ts}}
    hit = frozenset(i for i, (_, label) in enumerate(rows) if label == "block")
    least = {t for t, at in urls.items() if not any(o < t and urls[o] == at for o in urls)}
    sure = {}
    for size in range(1, 7):
        for items in itertools.combinations(sorted(urls if size == 1 else least), size):
            at = frozenset.intersection(*(urls[t] for t in items))
            n, hits = len(at), len(at & hit)
            if hits >= min_count and hits / n >= confidence and hits / n > len(hit) / len(rows):
                sure[items] = hits / n
    return {
        items: value for items, value in sure.items()
        if not any(sure.get(tuple(x for x in items if x != t), -1) >= value for t in items)
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_are_those_of_trying_every_set(spark, seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = [t for t in "abcdef" if draw.random() < 0.5] + [draw.choice("xyz")] * 2
        tokens += ["a2"] * ("a" in tokens) + ["common"]  # a and a2 are in the same urls
        bad = {"a", "b", "x"} <= set(tokens) or {"c", "d", "e", "y"} <= set(tokens) or draw.random() < 0.03
        rows.append((tokens, "block" if bad else "allow"))
    labels = spark.createDataFrame(rows, "tokens array<string>, label string")
    want = brute_rules(rows, 4, 0.7)
    got = {tuple(r["items"]): r["confidence"] for r in U.mine(labels, 4, 0.7).collect()}
    assert got == want and max(map(len, want)) > 3
    pairs = U.mine(labels, 4, 0.7, max_items=2)
    assert {tuple(r["items"]) for r in pairs.collect()} == {i for i in want if len(i) <= 2}


def test_a_token_of_most_urls_is_dealt_into_groups(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)] + [(3000, None)]
    urls = spark.createDataFrame(rows, "row long, token string")
    index = spark.createDataFrame([("hot", 1), ("hot", 2), ("t0", 3)], "token string, rule int")
    looked_up = U._looked_up(urls, index, "left")
    assert looked_up.count() == 2 * 2000 + 1000 + 1
    assert looked_up.filter("rule = 3").count() == 1


def test_no_pages(spark):
    frame = pages(spark, URLS).limit(0)
    mined = U.mine(U.labelled(frame, RULES))
    assert mined.count() == 0 and U.judge_urls(frame, RULES, mined).count() == 0
