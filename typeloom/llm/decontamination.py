"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is walked once along every training
text.  After each word it knows the longest run of words ending there that
occurs in some item, and so which windows of items end there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import text_or_empty, text_slices

#: Words of test items in one automaton; larger benchmarks are walked in blocks.
BLOCK_WORDS = 1_000_000
#: Bytes a word is made of, lower-cased; all others part words.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode().translate(FOLDED).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word lists, with the windows that count.

    A window is ``size`` consecutive words of an item, or a whole item of fewer
    words.  Strings never run from one item into the next.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], size: int):
        self.size = size
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[list[int]] = [[]]  # items by the states of their prefixes
        self.names: list[list[str]] = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        whole: dict[tuple[bytes, ...], int] = {}
        for name, words in items:
            if not words:
                continue
            item = whole.setdefault(tuple(words), len(self.names))
            if item < len(self.names):  # the same words again
                self.names[item].append(name)
                continue
            self.names.append([name])
            state = 0
            for word in words:
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)), ends)
                ends[state].append(item)
        for words, item in whole.items():
            if len(words) < size:
                state = 0
                for word in words:
                    state = self.next[state][self.ids[word]]
                self.short.setdefault(state, []).append((len(words), item))
        self.ends = ends
        self.children: list[list[int]] = [[] for _ in self.link]
        for state, link in enumerate(self.link):
            if link >= 0:
                self.children[link].append(state)
        # the nearest state on the way up, itself included, that is a whole short item
        self.nearest = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            link = self.link[state]
            above = self.nearest[link] if link >= 0 else -1
            self.nearest[state] = state if state in self.short else above
        self.found: dict[int, frozenset[int]] = {}

    def _extend(self, last: int, word: int, ends: list) -> int:
        there = self.next[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is not None:
            return self._split(last, word, there, ends)
        new = self._add(self.length[last] + 1, {}, 0, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            if self.length[there] == self.length[state] + 1:
                self.link[new] = there
            else:
                self.link[new] = self._split(state, word, there, ends)
        return new

    def _add(self, length: int, nexts: dict, link: int, ends: list) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int, there: int, ends: list) -> int:
        copy = self._add(
            self.length[state] + 1, dict(self.next[there]), self.link[there], ends
        )
        self.link[there] = copy
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _suffix(self, state: int, length: int) -> int:
        """The state that holds the suffix of this length of a state's strings."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def items_at(self, state: int) -> frozenset[int]:
        """Items in which the strings of a state occur."""
        if state not in self.found:
            items, todo = set(), [state]
            while todo:
                at = todo.pop()
                items.update(self.ends[at])
                todo.extend(self.children[at])
            self.found[state] = frozenset(items)
        return self.found[state]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans of hit words (begin, end) in order, joined; the items hit; the longest match."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        nexts, links, lengths, nearest = self.next, self.link, self.length, self.nearest
        get, size, longest = self.ids.get, self.size, 0
        first = nexts[0]
        state = matched = 0
        for end, word in enumerate(map(get, words), 1):
            if word is None:
                state = matched = 0
                continue
            if not state:  # most words follow no match
                state = first.get(word, 0)
                matched = 1 if state else 0
            else:
                while state and word not in nexts[state]:
                    state = links[state]
                    matched = lengths[state]
                state = nexts[state].get(word, 0)
                matched = matched + 1 if state else 0
            if matched > longest:
                longest = matched
            reach = 0
            if matched >= size:
                items |= self.items_at(self._suffix(state, size))
                reach = size
            at = nearest[state]
            while at >= 0:
                for length, item in self.short[at]:
                    if length <= matched:
                        items.add(item)
                        reach = max(reach, length)
                at = nearest[links[at]] if links[at] >= 0 else -1
            if reach:
                begin = end - reach
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, end))
        return spans, items, longest


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, size: int, words: int):
    """Automata over blocks of the items, pickled."""
    block, held = [], 0
    rows = benchmark.select(
        F.coalesce(benchmark[item_column].cast("string"), F.lit("")).alias("name"),
        text_or_empty(benchmark, text_column).alias("text"),
    )
    for row in rows.toLocalIterator():
        item = words_of(row["text"])
        if block and held + len(item) > words:
            yield pickle.dumps(SuffixAutomaton(block, size))
            block, held = [], 0
        block.append((row["name"], item))
        held += len(item)
    yield pickle.dumps(SuffixAutomaton(block, size))


SPANS = "array<struct<begin: int, end: int>>"


def _matched(
    docs, benchmark, size, text_column, item_column, item_text, block_words, cut: bool = False
) -> DataFrame:
    """``docs`` with its columns renamed c0, c1, ... and n_words, spans, item_names, longest_match.

    With ``cut`` the texts lose their spans in the same pass: a step of its own would have a Python
    worker more for each task, and all of them are used again by what comes later.
    """
    context = docs.sparkSession.sparkContext
    shared = [
        context.broadcast(block)
        for block in _blocks(benchmark, item_column, item_text, size, block_words)
    ]

    place = f"c{docs.columns.index(text_column)}"

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = pickle.loads(shared[0].value) if len(shared) == 1 else None
        for batch, texts in text_slices(batches, "match_text"):
            words = [words_of(text) for text in texts]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            longest = [0] * len(texts)
            for block in shared:
                automaton = only or pickle.loads(block.value)
                for i, row in enumerate(words):
                    found, items, reach = automaton.matches(row)
                    longest[i] = max(longest[i], reach)
                    spans[i] += found
                    for item in items:
                        names[i].update(automaton.names[item])
            spans = [_joined(s) for s in spans]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "match_text"}
            if cut:
                left = columns[place].to_pylist()
                left = [remove_spans(t, s) if s else t for t, s in zip(left, spans, strict=True)]
                columns[place] = pa.array(left, pa.string())
            columns |= {
                "n_words": pa.array(map(len, words), pa.int64()),
                "spans": pa.array(
                    [[{"begin": b, "end": e} for b, e in s] for s in spans],
                    pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])),
                ),
                "item_names": pa.array([sorted(s) for s in names], pa.list_(pa.string())),
                "longest_match": pa.array(longest, pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = F.col(place).cast("string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.withColumn("match_text", F.coalesce(text, F.lit(""))).mapInArrow(
        match,
        f"{schema}, n_words long, spans {SPANS}, item_names array<string>, longest_match int",
    )


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, spans, item_names, longest_match) of every row of ``docs``.

    ``spans`` are (begin, end) word places inside occurrences of windows of
    ``size`` words of an item (or whole shorter items), joined and in order;
    ``item_names`` the items with such windows, as strings, distinct and sorted.
    Null texts have no words; items without words match nothing; equal items
    are all named; repeated ids give repeated rows; other columns are not read.
    Texts are streamed against the automata of blocks of at most
    ``block_words`` words and one item.
    """
    found = _matched(
        docs.select(id_column, text_column),
        benchmark,
        size,
        text_column,
        item_column,
        item_text,
        block_words,
    )
    return found.select(
        F.col("c0").alias(id_column), "n_words", "spans", "item_names", "longest_match"
    )


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def hit_words(spans_column: str = "spans") -> F.Column:
    return F.aggregate(
        spans_column, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"])
    )


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, from each first to each last word."""
    data = text.encode()
    folded = data.translate(FOLDED)
    places, at = [], 0
    for word in folded.split(b" "):
        if word:
            places.append((at, at + len(word)))
        at += len(word) + 1
    out, last = [], 0
    for begin, end in spans:
        out.append(data[last : places[begin][0]])
        last = places[end - 1][1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    max_coverage: float = 0.5,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` cleaned of benchmark passages, in the same columns.

    Texts lose the words inside occurrences of ``size``-word windows; a text of
    which more than ``max_coverage`` was hit goes as a whole.  Texts without a
    hit, null and empty ones included, stay as they are.
    """
    found = _matched(docs, benchmark, size, text_column, item_column, item_text, block_words, cut=True)
    kept = found.filter(hit_words() <= F.col("n_words") * max_coverage)
    return kept.select(*(c for c in found.columns if c[0] == "c")).toDF(*docs.columns)
