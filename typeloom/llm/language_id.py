"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.  The
probability of a word is the sum, over all ways to cut it into pieces, of the product of
their probabilities: the forward algorithm, from the word's beginning, adds up every
piece that ends at a place.  No piece crosses a word, so a text's probability is the product
over its words.  Expectation-maximisation fits the piece probabilities to
the words of each language, counted over all training texts: the forward and the backward
sums give the expected count of every piece in every place.

Words are runs of letters in lower case.  A character without a piece is written as its
UTF-8 bytes, each of which has one.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import work_folder
from typeloom.llm.common import text_or_empty, text_slices, worker_cache

UNDETERMINED = "und"
#: Sentencepiece writes the blank before a word so.
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: A byte of a character that has no piece, as one character of a private area.
BYTE = 0xF0000
#: Passes over the words; the first starts from equal probabilities.
ROUNDS = 3
#: Weight of all languages together in the estimate of one, in expected pieces.
PRIOR = 2000.0
#: Share of equal probabilities in the estimate of all languages together.
FLOOR = 1e-3
#: Words whose probabilities a worker keeps.
KEPT_WORDS = 300_000
#: Words of up to so many places are taken in batches, longer ones one by one with scaling.
SHORT = 40
BATCH = 4096
#: Size of the trie's hash table, a power of two, and its multiplier (2**64 by the golden ratio).
SLOTS = 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: numbers of pieces, by their text."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.number: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                piece = chr(BYTE + int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            elif START in piece[1:] or not (piece == START or piece.lstrip(START).isalpha()):
                continue  # never part of a word
            elif piece != piece.lower():
                continue
            self.number[piece] = len(self.number)
        for byte in range(256):
            self.number.setdefault(chr(BYTE + byte), len(self.number))
        self.size = len(self.number)
        self.longest = max(map(len, self.number))
        self.ascii = all(c in self.number for c in "abcdefghijklmnopqrstuvwxyz")
        self._make_trie()

    def _make_trie(self) -> None:
        """Steps (state, character) -> state in a hash table, and the piece that ends in each state."""
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.number.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = i
        self.ends = np.array(ends, np.int32)
        self.keys = np.full(1 << SLOTS, -1, np.int64)
        self.nexts = np.zeros(1 << SLOTS, np.int32)
        slots = self._slots(np.fromiter(steps, np.int64, len(steps)))
        for slot, (key, state) in zip(slots.tolist(), steps.items(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % (1 << SLOTS)
            self.keys[slot], self.nexts[slot] = key, state

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after one more character, 0 where no piece goes on."""
        keys = states.astype(np.int64) << 21 | codes
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.nexts[slots], 0)
        going = np.flatnonzero((held != keys) & (held >= 0))
        while len(going):  # another key has the slot: look at the next one
            slots[going] = (slots[going] + 1) % (1 << SLOTS)
            held = self.keys[slots[going]]
            same = held == keys[going]
            out[going[same]] = self.nexts[slots[going[same]]]
            going = going[~same & (held >= 0)]
        return out

    def cells(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words, pieces): where pieces lie in written words, by begin.

        All words walk the trie together, from one begin after the other.
        """
        places = max(map(len, texts))
        padded = "".join(t.ljust(places, "\0") for t in texts).encode("utf-32-le")
        codes = np.ascontiguousarray(np.frombuffer(padded, np.uint32).reshape(-1, places).T)
        sizes = np.array([len(t) for t in texts])
        for begin in range(places):
            rows = np.flatnonzero(sizes > begin)
            states = np.zeros(len(rows), np.int32)
            for end in range(begin + 1, places + 1):
                states = self._step(states, codes[end - 1, rows])
                alive = states > 0
                rows, states = rows[alive], states[alive]
                if not len(rows):
                    break
                pieces = self.ends[states]
                whole = pieces >= 0
                if whole.any():
                    yield begin, end, rows[whole], pieces[whole]

    def written(self, word: str) -> str:
        """A word with its start and with characters that have no piece as bytes."""
        number = self.number
        if self.ascii and word.isascii() or all(c in number for c in word):
            return START + word
        parts = (c if c in number else "".join(chr(BYTE + b) for b in c.encode()) for c in word)
        return START + "".join(parts)

    def edges(self, text: str, backwards: bool = False) -> Iterator[tuple[int, int, int]]:
        """(end, begin, piece) of all pieces in a written word, by end."""
        get = self.number.get
        ends = range(1, len(text) + 1)
        for end in reversed(ends) if backwards else ends:
            for begin in range(max(0, end - self.longest), end):
                piece = get(text[begin:end])
                if piece is not None:
                    yield end, begin, piece


def forward(pieces: Pieces, texts: list[str], p: np.ndarray, cells: list | None = None) -> np.ndarray:
    """Sums over all segmentations up to each place: (places + 1, words, languages).

    What was looked up is added to ``cells``, if given.
    """
    alpha = np.zeros((max(map(len, texts)) + 1, len(texts), p.shape[1]))
    alpha[0] = 1
    for cell in pieces.cells(texts):
        begin, end, rows, found = cell
        alpha[end, rows] += alpha[begin, rows] * p[found]
        if cells is not None:
            cells.append(cell)
    return alpha


def _scaled_forward(pieces: Pieces, text: str, p: np.ndarray) -> np.ndarray:
    """Logs of the sums over all segmentations up to each place of one long word."""
    logs = np.full((len(text) + 1, p.shape[1]), -np.inf)
    logs[0] = 0
    now, at, base = np.zeros(p.shape[1]), 0, logs[0]
    with np.errstate(divide="ignore"):
        for end, begin, piece in pieces.edges(text):
            if end != at:
                if at:
                    logs[at] = base + np.log(now)
                # The sums are taken relative to the last place that a piece ends at.
                base = logs[end - 1] if np.isfinite(logs[end - 1]).all() else logs[begin]
                now, at = np.zeros(p.shape[1]), end
            now += np.exp(logs[begin] - base) * p[piece]
        logs[at] = base + np.log(now)
    return logs


def word_logs(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """log probability of each word (plain, in lower case) in each language."""
    out = np.empty((len(words), p.shape[1]))
    texts = [pieces.written(w) for w in words]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    cut = next((k for k, i in enumerate(order) if len(texts[i]) > SHORT), len(order))
    for at in range(0, cut, BATCH):
        some = order[at : min(at + BATCH, cut)]
        sizes = [len(texts[i]) for i in some]
        alpha = forward(pieces, [texts[i] for i in some], p)
        out[some] = np.log(alpha[sizes, np.arange(len(some))])
    for i in order[cut:]:
        out[i] = _scaled_forward(pieces, texts[i], p)[-1]
    return out


def expected_counts(pieces: Pieces, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(piece, language): how often each piece is expected; ``counts`` (words, languages)."""
    out = np.zeros_like(p)
    texts = [pieces.written(w) for w in words]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    cut = next((k for k, i in enumerate(order) if len(texts[i]) > SHORT), len(order))
    for at in range(0, cut, BATCH):
        some = order[at : min(at + BATCH, cut)]
        sizes, cells = [len(texts[i]) for i in some], []
        alpha = forward(pieces, [texts[i] for i in some], p, cells)
        whole = alpha[sizes, np.arange(len(some))]
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(some))] = counts[some] / whole
        found_all, shares = [], []
        for begin, end, rows, found in reversed(cells):
            passed = beta[end, rows] * p[found]
            beta[begin, rows] += passed
            found_all.append(found)
            shares.append(alpha[begin, rows] * passed)
        found, share = np.concatenate(found_all), np.concatenate(shares)
        for lang in range(p.shape[1]):
            out[:, lang] += np.bincount(found, share[:, lang], len(p))
    for i in order[cut:]:
        text = texts[i]
        logs, back = _scaled_forward(pieces, text, p), np.full((len(text) + 1, p.shape[1]), -np.inf)
        back[-1] = 0
        for end, begin, piece in pieces.edges(text, backwards=True):
            passed = back[end] + np.log(p[piece])
            back[begin] = np.logaddexp(back[begin], passed)
            out[piece] += counts[i] * np.exp(logs[begin] + passed - logs[-1])
    return out


def estimated(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of each language, smoothed by those of all languages together."""
    together = counts.sum(axis=1, keepdims=True)
    together = (1 - FLOOR) * together / max(together.sum(), 1e-300) + FLOOR / len(counts)
    return (counts + PRIOR * together) / (counts.sum(axis=0, keepdims=True) + PRIOR)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class WordScorer:
    """Log probabilities of texts; those of the first ``KEPT_WORDS`` words are kept."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.kept: dict[str, int] = {}
        self.logs = np.zeros((0, p.shape[1]))

    def sums(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the sums of its words' logs; 0 without a letter."""
        rows = [words_of(text) for text in texts]
        new = list({w for row in rows for w in row if w not in self.kept})
        logs = np.zeros((len(new), self.p.shape[1]))
        lettered = [i for i, w in enumerate(new) if has_letter(w)]  # not of number signs alone
        if lettered:
            logs[lettered] = word_logs(self.pieces, [new[i] for i in lettered], self.p)
        known = len(self.kept)
        room = max(0, KEPT_WORDS - known)
        self.kept.update(zip(new[:room], range(known, known + room), strict=False))
        every = np.concatenate([self.logs, logs])
        self.logs = every[: known + room]
        number = self.kept
        if len(new) > room:
            number = self.kept | dict(zip(new[room:], range(known + room, len(every)), strict=True))
        get = number.__getitem__
        for row in rows:
            yield every[np.fromiter(map(get, row), np.int64, len(row))].sum(axis=0)


def _worker_pieces(path: str) -> Pieces:
    return worker_cache(f"pieces:{path}", lambda: Pieces(path))


def word_counts(docs: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(lang, word, n) over all texts; words are runs of letters in lower case.

    Texts are read in slices, the counts of each slice added up before any is shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, own in found.items():
                own = {word: n for word, n in own.items() if has_letter(word)}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(own), pa.string()),
                        pa.array(list(own), pa.string()),
                        pa.array(list(own.values()), pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )

    taken = docs.select(docs[lang_column].cast("string").alias("lang"), text_or_empty(docs, text_column).alias("text"))
    counted = taken.filter("lang is not null").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Piece probabilities (pieces, languages) over the vocabulary in ``path``."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.path, self.langs, self.p = path, langs, p


def fit(docs: DataFrame, path: str, lang_column: str = "lang", text_column: str = "text", rounds: int = ROUNDS) -> Model:
    """A model of all labelled texts, null labels left out.

    The words of the texts are counted once and written to the work folder; each round reads them,
    sums expected piece counts in the tasks, and the sums of all tasks meet by piece.  What
    reaches the driver is a number for each piece and language.  Without a labelled text the
    model knows no language.
    """
    spark = docs.sparkSession
    counted, folder = word_counts(docs, lang_column, text_column), f"{work_folder(spark)}/words"
    counted.write.parquet(folder)
    counted = spark.read.schema(counted.schema).parquet(folder)
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    pieces = Pieces(path)
    p = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, now = _worker_pieces(path), shared.value
            place = {lang: i for i, lang in enumerate(langs)}
            total = np.zeros_like(now)
            for batch in batches:
                words, index, at = batch.column("word").to_pylist(), {}, []
                for word in words:
                    at.append(index.setdefault(word, len(index)))
                counts = np.zeros((len(index), len(langs)))
                column = [place[lang] for lang in batch.column("lang").to_pylist()]
                np.add.at(counts, (at, column), batch.column("n").to_numpy())
                total += expected_counts(own, list(index), counts, now)
            found, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[found, lang])],
                ["piece", "lang", "n"],
            )

        sums = counted.mapInArrow(expect, "piece int, lang int, n double")
        rows = sums.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(p)
        counts[rows["piece"], rows["lang"]] = rows["n"]
        p = estimated(counts)
        shared.unpersist()
    return Model(path, langs, p)


def languages(docs: DataFrame, model: Model, id_columns: list[str | Column], text_column: str = "text") -> DataFrame:
    """(id columns, lang_pred, score) of every whole text.

    ``score`` is the probability of the language among the learned ones, all equally likely
    before the text is read; of equal ones the first by name is taken.  A null text, one without a letter, and
    every text of a model without languages are ``und`` with score 0.  Repeated rows are
    judged each; an empty table gives no row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.path, model.langs, model.p))
    kept_as = f"languages:{uuid.uuid4().hex}"
    ids = [docs[c] if isinstance(c, str) else c for c in id_columns]
    taken = docs.select(
        F.struct(*ids).alias("ids"), text_or_empty(docs, text_column).alias("text")
    )

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, langs, p = shared.value
        scorer = worker_cache(kept_as, lambda: WordScorer(Pieces(path), p))
        for batch, texts in text_slices(batches):
            preds, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for i, sums in enumerate(scorer.sums(texts) if langs else ()):
                if sums.any():  # a letter has a probability below 1
                    best = int(np.argmax(sums))
                    preds[i] = langs[best]
                    scores[i] = 1.0 / np.exp(sums - sums[best]).sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), pa.array(preds, pa.string()), pa.array(scores)],
                ["ids", "lang_pred", "score"],
            )

    id_type = taken.schema["ids"].dataType.simpleString()
    return taken.mapInArrow(judge, f"ids {id_type}, lang_pred string, score double").select(
        "ids.*", "lang_pred", "score"
    )
