"""Quality rules, benchmark matches and personal data against plain Python."""

import hashlib
import random
import re

import pytest

from frames import ODD, odd_docs, rows_of
from pyspark.sql import functions as F
from typeloom.llm import pii
from typeloom.llm.decontamination import (
    SuffixAutomaton,
    _joined,
    benchmark_matches,
    decontaminate,
    remove_spans,
    words_of,
)
from typeloom.llm.pii import BASE_KINDS, EXPECTED, LABELERS, estimate, personal_data, redacted
from typeloom.llm.quality_rules import clean, quality_rules

PROSE = "The small boat went out early in the morning and came back late. "


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_statistics(spark):
    draw = random.Random(2)
    texts = [None, "", " \n", PROSE * 6, "x\nx\n\nx\ny", "a b c a b c d", "\u00a0é \x85 |<> #"]
    texts += [" ".join(draw.choice(["a", "b,", "#c", "d\n", "é."]) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    docs = odd_docs(spark, list(enumerate(texts)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in quality_rules(docs).collect()}
    assert got == {i: brute_quality(t or "") for i, t in enumerate(texts)}


def test_lines_that_fail_are_lost(spark):
    words = [f"word{i}" for i in range(60)]
    good = " ".join(words) + "."
    menu = " | ".join(f"item{i}" for i in range(60))
    rows = [(1, good), (2, f"{good}\nHome | News | Sport | Help\nAll rights reserved."), (3, f"{good}\n{menu}\n{menu}x")]
    kept = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in quality_rules(odd_docs(spark, rows)).collect()}
    assert kept[1] == (True, good) and kept[2] == (True, good) and not kept[3][0]
    cleaned = clean(odd_docs(spark, rows))
    assert cleaned.columns == odd_docs(spark, rows).columns
    assert rows_of(cleaned, "doc_id", "text", "kept") == [(1, good, "x"), (2, good, "x")]


def test_odd_rows_have_results(spark):
    assert quality_rules(odd_docs(spark)).count() == len(ODD)
    assert clean(odd_docs(spark, [])).count() == 0
    assert personal_data(odd_docs(spark, [])).count() == 0


def brute_matches(text, items, size):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        item = words_of(item)
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} or ({tuple(item)} if item else set())
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(name)
    return hit, found


def test_automaton_finds_all_windows():
    draw = random.Random(1)
    for _ in range(800):
        letters = ["a", "B", "dé", "5"][: draw.randint(1, 4)]
        items = [(str(i), " ".join(draw.choice(letters) for _ in range(draw.randint(0, 7)))) for i in range(draw.randint(0, 6))]
        size = draw.randint(1, 4)
        automaton = SuffixAutomaton([(n, words_of(t)) for n, t in items], size)
        text = ", ".join(draw.choice([*letters, "zz"]) for _ in range(draw.randint(0, 14)))
        spans, found, _ = automaton.matches(words_of(text))
        hit, names = brute_matches(text, items, size)
        assert {x for b, e in _joined(spans) for x in range(b, e)} == hit
        assert {n for i in found for n in automaton.names[i]} == names


@pytest.mark.parametrize("block_words", [1, 1000])
def test_matches_in_blocks(spark, block_words):
    items = spark.createDataFrame(
        [(1, "a b c d"), (2, "x Y"), (3, None), (4, "?"), (5, "b c d"), (None, "q q q"), (1, "a b c d")], "item_id long, text string"
    )
    docs = odd_docs(spark, [*ODD, (7, "z a B, c d z x y"), (8, "q q q q")])
    found = benchmark_matches(docs, items, size=3, block_words=block_words)
    got = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["item_names"]) for r in found.collect()}
    assert got[7] == (8, [(1, 5), (6, 8)], ["1", "2", "5"]) and got[8] == (4, [(0, 4)], [""])
    assert got[1] == (0, [], []) and found.count() == len(ODD) + 2
    left = decontaminate(docs, items, size=3, max_coverage=0.8, block_words=block_words)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[7] == "z  z " and 8 not in texts and texts[1] is None and left.columns == docs.columns
    assert decontaminate(docs, items.limit(0), size=3).count() == docs.count()


def test_words_go_and_the_rest_stays():
    assert remove_spans("Ä, b! c (d)\n", [(1, 3)]) == "Ä,  (d)\n"


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def pii_texts():
    draw = random.Random(4)
    pieces = ["a@b.c", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "0010.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (434) 555-2368", "+12", "x", "é", " ", ".", "-", "7", "@", "+", "\n", "49927398716", "6011000990139424 ", "..a@-.b"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 9))) for _ in range(500)]
    return [None, "", *texts, "7" * 20000, "a" * 50000 + "@", "1.1" * 5000]


def test_base_spans_are_the_patterns(spark):
    texts = pii_texts()
    found = personal_data(odd_docs(spark, list(enumerate(texts)))).collect()
    for r in found:
        base = brute_base(texts[r["doc_id"]] or "")
        listed = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert [x for x in r["spans"].split(",") if not x.startswith("other")] == (listed.split(","))
    assert len(found) == len(texts)


def test_labelers_outvote_noise(spark):
    rows = [(i, f"some words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(40)]
    rows += [(100 + i, f"as of version release-{i} and 2021-01-{10 + i} nothing") for i in range(40)]
    rows += [(200, "write to jane(at)mail(dot)com or +1 (434) 555-2368")]
    docs = odd_docs(spark, rows)
    n = {r["doc_id"]: r["n_other"] for r in personal_data(docs).collect()}
    assert all(n[i] == 1 for i in range(40)) and not any(n[100 + i] for i in range(40))
    texts = {r["doc_id"]: r["text"] for r in redacted(docs).collect()}
    assert texts[0] == 'some words token = "[OTHER]" and more' and texts[100] == rows[40][1]
    assert texts[200].endswith("or [PHONE]")


def test_em_tells_reliable_labelers():
    zero = dict.fromkeys(LABELERS, 0)
    yes = tuple((zero | {"field": 1, "mixed": 1}).values())
    no = tuple((zero | {"plain": -1, "near": 1}).values())
    prior, rates = estimate([(yes, 300), (no, 700)])
    assert abs(prior - 0.3) < 0.05
    assert rates["field"][1][0] > 0.9 > 0.1 > rates["field"][1][1] and set(rates["near"]) == set(EXPECTED)


def test_names_streets_and_values_behind_fields_are_candidates(spark):
    key = "Ab1" + "xYz9" * 100
    texts = {
        "We met Alice Brandt yesterday.": ("Alice Brandt", "gazetteer", 1),
        "He lives at 12 Elm Street now.": ("12 Elm Street", "gazetteer", 1),
        "flown to New York often": ("New York", "gazetteer", -1),
        "password: hunterhunter today": ("hunterhunter", "field", 1),
        "the passport no X12345 was lost": ("X12345", "field", 1),
        "the key is that we wait": ("that", "plain", -1),
        f"see {key} here": (key, "mixed", 1),
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    for row in docs.select("text", pii.candidates(text, pii.base_spans(text)).alias("c")).collect():
        span, labeler, vote = texts[row["text"]]
        found = {row["text"][c["start"] : c["end"]]: c for c in row["c"]}
        assert found[span][labeler] == vote, row["text"]


def test_shouting_takes_time_in_proportion(spark):
    import time

    from typeloom.llm.quality_rules import line_fails, SHOUTED

    draw = random.Random(8)
    lines = ["".join(draw.choice("aB-1 ÉßΣ\r") for _ in range(draw.randint(0, 7))) for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.col("x").rlike(SHOUTED).alias("y")).collect()
    for row in got:
        want = sum(c.isupper() for c in row.x) >= 2 and not any(c.islower() for c in row.x)
        assert row.y == want, repr(row.x)
    long = [("A" * 200_000 + "b",), ("AB " * 70_000 + "c",), ("- " * 100_000,), ("A" * 200_000,)]
    start = time.time()
    verdicts = spark.createDataFrame(long, "x string").select(line_fails(F.col("x"))).collect()
    assert time.time() - start < 30 and verdicts[-1][0]


def test_patterns_are_searched_once(spark):
    """Every mention of the pattern in the expression would be a search of its own."""
    found = pii.located(F.col("text"), "ab+", F.lit(True))
    assert str(found).count("ab+") == 1
    docs = spark.createDataFrame(
        [("abxabb\U0001f600ab",), ("none",), ("",), ("\uffffab\uffffx\ufffeab",), (None,)], "text string"
    )
    got = [[tuple(s) for s in r[0] or ()] for r in docs.select(found).collect()]
    assert got == [
        [("ab", 0, 2, "", "x"), ("abb", 3, 6, "x", "\U0001f600"), ("ab", 7, 9, "\U0001f600", "")],
        [],
        [],
        [("ab", 1, 3, "\ufffe", "\ufffex\ufffe"), ("ab", 6, 8, "\ufffex\ufffe", "")],
        [],
    ]


def test_texts_are_matched_and_cut_in_one_pass(spark):
    """Each further Python step of a task has a worker of its own, which stays with all it keeps."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "x y"), (4, "b c d")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "b c d")], "item_id string, text string")
    left = decontaminate(docs, items, size=3, max_coverage=0.8)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, left.collect())) == [(1, "a  e"), (2, None), (3, "x y")]
