"""Token counts and packing against the tokenizers themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from frames import ODD, odd_docs, rows_of
from typeloom.llm import common, packing
from typeloom.llm.packing import WordEncoder, pack
from typeloom.llm.token_counts import (
    class_table,
    compose_scan,
    count_tokens,
    piece_starts,
    token_counts,
)

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LETTERS = "abcdreslvtmé'' ''  \n\t\r \u3000!?#1٣2\u0301中😀\x1c\x85ſKİΣςX<|>"


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    out = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(n)]
    for _ in range(n):
        ranges = [(0, 0x2FF), (0, 0xD7FF), (0xE000, 0x10FFFF)]
        out.append("".join(chr(draw.randint(*draw.choice(ranges))) for _ in range(30)))
    return [*out, "a" * 3000, "<|endoftext|>", "<|ENDOFTEXT|> <|startoftext|>x", "'r", "'ll're", " \n  'd"]


def test_counts_equal_the_library():
    texts, tokenizer = odd_texts(600), Tokenizer.from_file(BYTES)
    classes = np.frombuffer(class_table(BYTES), np.uint8)
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert count_tokens(texts, BYTES, classes).tolist() == want


def test_chunks_change_no_piece():
    classes = np.frombuffer(class_table(BYTES), np.uint8)
    text = "".join(odd_texts(80, 5))
    kinds = classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    whole = piece_starts(kinds, len(kinds))
    for chunk in (1, 2, 7, 64):
        assert piece_starts(kinds, chunk).tolist() == whole.tolist()


def test_scan_composes_maps():
    maps = np.random.default_rng(1).integers(0, 5, (37, 5)).astype(np.uint8)
    state, scanned = np.arange(5), compose_scan(maps)
    for one, upto in zip(maps, scanned, strict=True):
        state = one[state]
        assert upto.tolist() == state.tolist()


def test_token_counts_of_odd_rows(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    got = rows_of(token_counts(odd_docs(spark), BYTES, 10), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, text in ODD:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 10))
    assert got == sorted(want, key=repr)
    assert token_counts(odd_docs(spark, []), BYTES, 10).count() == 0


def test_words_encode_as_the_library():
    texts, tokenizer = odd_texts(600, 3), Tokenizer.from_file(WORDS)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in WordEncoder(WORDS).encode(texts)] == want


@pytest.mark.parametrize("window", [7, 2048])
def test_pieces_make_up_the_documents(spark, window):
    tokenizer = Tokenizer.from_file(WORDS)
    pieces = pack(odd_docs(spark).repartition(3), WORDS, 1, window).collect()
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0 and zlib.crc32(p["ids"]) == p["ids_crc32"]
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        filled = sequences.setdefault(p["sequence_id"], 0)
        assert p["offset"] == filled
        sequences[p["sequence_id"]] = filled + p["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert [n for _, n in sorted(sequences.items())][:-1] == [window] * (len(sequences) - 1)
    # laid end to end the pieces are the documents
    line = np.concatenate(
        [np.frombuffer(p["ids"], "<u4") for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))]
    )
    got = sorted("".join(f"{i}," for i in x) for x in np.split(line, np.flatnonzero(line == 1) + 1) if len(x))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ODD]
    assert got == sorted("".join(f"{i}," for i in x) for x in want)


def test_nothing_to_pack(spark):
    assert pack(odd_docs(spark, []), WORDS, 1, 8).count() == 0


@pytest.mark.parametrize("text", ["=-" * 60_000, "the" * 30_000 + "xqzj" * 10_000, " " * 50_000 + "x", "中文字" * 5_000])
def test_long_pieces_count_as_the_library(text):
    classes = np.frombuffer(class_table(BYTES), np.uint8)
    want = len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)
    assert count_tokens([text], BYTES, classes).tolist() == [want]


def test_a_full_cache_changes_no_id(monkeypatch):
    from typeloom.llm import packing

    texts, tokenizer = [*odd_texts(60, 4), "a b c a b", "d e f a"], Tokenizer.from_file(WORDS)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "TOGETHER", 4)
    encoder = WordEncoder(WORDS)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert len(encoder.kept) == 3


def test_plain_words_skip_the_normalizer():
    path = P.path("word_bpe_49k.json")
    encoder = WordEncoder(path)
    assert encoder.bare.normalizer is None
    texts = ["a\x0bb c\x1cd\x1f  E\t\r\nf", "A<|endoftext|>b <|x", "Ünï é é ǅ İ x\xa0y z", "don't 12ab ---- \x00 a\x7fb", ""]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_words_of_one_call_are_not_kept(spark, monkeypatch):
    """What KEPT_WORDS leaves out goes once its texts are encoded."""
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    encoder = WordEncoder(WORDS)
    encoder.encode(["some words that are not kept"])
    assert len(encoder.kept) == 2 and not encoder.kept.others


def test_arrow_gives_memory_back_between_batches(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_arrays([pa.array(t)], ["text"]) for t in (["a", None], ["b"])]
    assert [texts for _, texts in common.text_slices(batches)] == [["a", ""], ["b"]]
    assert len(calls) == 2
