"""Language identification against sums over all segmentations, one by one."""

import numpy as np
import public_tokenizers as P
import pytest

from frames import odd_docs
from typeloom.llm import language_id as lid

PATH = P.path("piece_bpe_32k.model")
SENTENCES = {
    "en": "the house with the small garden is where they have been living",
    "de": "das kleine haus mit dem garten ist dort wo sie gewohnt haben",
    "fr": "la petite maison avec le jardin est là où elles ont vécu",
}


@pytest.fixture(scope="module")
def pieces():
    return lid.Pieces(PATH)


def drawn(pieces, langs=3, seed=1):
    return np.random.default_rng(seed).dirichlet(np.full(pieces.size, 0.5), langs).T + 1e-9


def segmentations(pieces, text):
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        if text[:end] in pieces.number:
            for rest in segmentations(pieces, text[end:]):
                yield [pieces.number[text[:end]], *rest]


WORDS = ["the", "house", "là", "a", "vécu", "中文", "ⴰⴱx", "ſ", "garten"]


def test_forward_sums_all_segmentations(pieces):
    p = drawn(pieces)
    got = lid.word_logs(pieces, WORDS, p)
    for word, row in zip(WORDS, got, strict=True):
        cuts = list(segmentations(pieces, pieces.written(word)))
        want = sum(np.prod(p[cut], axis=0) for cut in cuts)
        assert np.allclose(row, np.log(want)), word
    assert len(list(segmentations(pieces, pieces.written("house")))) > 3


def test_expected_counts_of_all_segmentations(pieces):
    p, counts = drawn(pieces), np.arange(1.0, 3 * len(WORDS) + 1).reshape(-1, 3)
    want = np.zeros_like(p)
    for word, n in zip(WORDS, counts, strict=True):
        cuts = list(segmentations(pieces, pieces.written(word)))
        weights = np.array([np.prod(p[cut], axis=0) for cut in cuts])
        for cut, share in zip(cuts, weights / weights.sum(axis=0), strict=True):
            for piece in cut:
                want[piece] += n * share
    assert np.allclose(lid.expected_counts(pieces, WORDS, counts, p), want)


def test_long_words_are_scaled_not_cut(pieces, monkeypatch):
    p = drawn(pieces)
    words, counts = ["thehouse" * 4, "garten"], np.ones((2, 3))
    short = lid.word_logs(pieces, words, p), lid.expected_counts(pieces, words, counts, p)
    monkeypatch.setattr(lid, "SHORT", 3)
    assert np.allclose(lid.word_logs(pieces, words, p), short[0])
    assert np.allclose(lid.expected_counts(pieces, words, counts, p), short[1])
    logs = lid.word_logs(pieces, ["thehouse" * 5000], p)
    assert np.isfinite(logs).all() and (logs < -10_000).all()


def test_kept_words_change_no_sum(pieces, monkeypatch):
    p, texts = drawn(pieces), ["the house", "", "the garden ½ ²", "²", "house house"]
    whole = list(lid.WordScorer(pieces, p).sums(texts))
    monkeypatch.setattr(lid, "KEPT_WORDS", 2)
    scorer = lid.WordScorer(pieces, p)
    for _ in range(2):
        assert np.allclose(list(scorer.sums(texts)), whole)
    assert len(scorer.kept) == 2 and not whole[1].any() and not whole[3].any()


def test_rounds_raise_the_likelihood(pieces):
    words = sorted(set(" ".join(SENTENCES.values()).split()))
    counts = np.array([[s.split().count(w) for s in SENTENCES.values()] for w in words], float)
    p, before = np.full((pieces.size, 3), 1 / pieces.size), -np.inf
    for _ in range(4):
        now = (counts * lid.word_logs(pieces, words, p)).sum()
        assert now > before
        before, p = now, lid.estimated(lid.expected_counts(pieces, words, counts, p))
        assert np.allclose(p.sum(axis=0), 1)


def test_languages_of_texts(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(SENTENCES.items())]
    rows += [(7, "no label", None), (8, "", "en"), (9, None, "de")]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH)
    assert model.langs == ["de", "en", "fr"]
    asked = [(1, "the garden", "en"), (2, "der kleine garten", "de"), (3, "une petite maison où", "fr"),
             (3, "THE HOUSE", "en"), (4, None, "und"), (5, " 12 ½ !", "und"), (6, "", "und"), (None, "haus", "de")]
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = lid.languages(docs, model, ["doc_id", docs["lang"].alias("want")]).collect()
    assert len(got) == len(asked)
    for row in got:
        assert row.lang_pred == row.want
        assert row.score == 0 if row.want == "und" else 1 / 3 < row.score <= 1


def test_odd_rows_and_no_labels(spark):
    docs = odd_docs(spark)
    none = lid.fit(docs.selectExpr("text", "cast(null as string) as lang"), PATH)
    assert {r.lang_pred for r in lid.languages(docs, none, ["doc_id"]).collect()} == {"und"}
    one = lid.fit(docs.selectExpr("text", "'xx' as lang"), PATH)
    got = lid.languages(docs, one, ["doc_id"]).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} == {"xx", "und"}
    assert lid.languages(docs.limit(0), one, ["doc_id"]).collect() == []


def test_held_out_languages(spark):
    from typeloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.95
