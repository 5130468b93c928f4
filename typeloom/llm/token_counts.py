"""Token counts by compiled finite-state transducers.

The tokenizer file is compiled into two deterministic machines.

* The *splitter* reads one character class at a time and marks where its
  pieces begin.  It has 14 states, so what a chunk of text does is a map of 14
  states to 14 states.  Maps of chunks are computed side by side, composed by
  a parallel prefix scan, and only then the chunks, whose entry states are now
  known, are read once more for their marks.
* The *piece transducer* reads the bytes of a piece.  Its states are the
  prefixes met so far and are made when first met; a transition carries by how
  much the token count changes, so the sum along a piece is its token count.
  Sums of whole pieces are kept, up to a bound, and so are states.

Counts equal those of the library the file belongs to, without begin, end or
added special tokens; a special token's string inside a text is that one token.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from typeloom.llm.common import text_or_empty, text_slices, worker_cache

#: Characters read side by side; a slice of 2 M characters gives about 2,000 chunks.
CHUNK = 1024
#: Pieces whose counts a worker keeps, and states of its piece transducer.
KEPT_PIECES = 1_000_000
KEPT_STATES = 500_000
#: Bytes up to which the states of all prefixes of a piece are kept, and found by recursion.
LONG_PIECE = 64

# character classes of the splitter
OTHER, LETTER, STEM, R, V, L_, E, NUMBER, SPACE, WHITE, QUOTE, END = range(12)
N_CLASSES = 12
LETTERS = (LETTER, STEM, R, V, L_, E)
# states of the splitter
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED,
 ONE_SPACE, ONE_WHITE, MANY_SPACE, MANY_WHITE) = range(13)
N_STATES = 13
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before it


def _fresh(cls: int) -> int:
    """State after a character that begins a piece."""
    if cls in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, QUOTE: QUOTED}.get(cls, IN_OTHERS)


def _joined(cls: int) -> int:
    """State after a character that a single space before it belongs to."""
    state = _fresh(cls)
    return IN_OTHERS if state == QUOTED else state


def _step(state: int, cls: int) -> tuple[int, int]:
    late = BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0
    if cls == END:
        return START, late
    if cls in (SPACE, WHITE):
        if state in (ONE_SPACE, ONE_WHITE, MANY_SPACE, MANY_WHITE):
            return (MANY_SPACE if cls == SPACE else MANY_WHITE), 0
        return (ONE_SPACE if cls == SPACE else ONE_WHITE), HERE | late
    if state == ONE_SPACE:
        return _joined(cls), 0
    if state == MANY_SPACE:
        return _joined(cls), BEFORE
    if state == MANY_WHITE:
        return _fresh(cls), BEFORE | HERE
    if state in (QUOTED_R, QUOTED_V) and cls == E or state == QUOTED_L and cls == L_:
        return CLOSED, 0
    if state in (IN_LETTERS, QUOTED_R, QUOTED_V, QUOTED_L):
        if cls in LETTERS:
            return IN_LETTERS, late
        return _fresh(cls), HERE | late
    if state == IN_NUMBERS and cls == NUMBER:
        return IN_NUMBERS, 0
    if state in (IN_OTHERS, QUOTED) and cls in (OTHER, QUOTE):
        return IN_OTHERS, 0
    if state == QUOTED and cls in (STEM, R, V, L_):
        return {STEM: CLOSED, R: QUOTED_R, V: QUOTED_V, L_: QUOTED_L}[cls], 0
    return _fresh(cls), HERE


@lru_cache
def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of every (state, class), flat, class fastest."""
    steps = [_step(s, c) for s in range(N_STATES) for c in range(N_CLASSES)]
    return (
        np.array([s for s, _ in steps], np.uint8),
        np.array([m for _, m in steps], np.uint8),
    )


@lru_cache
def class_table(path: str) -> bytes:
    """The class of every code point, as the file's own library sees it.

    Only characters that a newer Unicode version holds for letters, numbers or
    white space are asked for one by one; the library may know fewer.
    """
    split = Tokenizer.from_file(path).pre_tokenizer
    classes = np.full(0x110000, OTHER, np.uint8)
    known = regex.compile(r"[\p{L}\p{N}\s]")
    for code in range(0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or not known.match(char):
            continue
        # a letter goes with the a, a number with the 1, white space with neither ! nor them
        pieces = len(split.pre_tokenize_str(f"a{char}1{char}!{char}!"))
        classes[code] = {6: LETTER, 5: NUMBER, 7: WHITE}.get(pieces, OTHER)
    for chars, cls in (("stmd", STEM), ("r", R), ("v", V), ("l", L_), ("e", E), (" ", SPACE), ("'", QUOTE)):
        for char in chars:
            classes[ord(char)] = cls
    return classes.tobytes()


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, in log2(n) vector steps.

    ``maps[i]`` sends an entry state of chunk i to its exit state; the result's
    row i sends an entry state of chunk 0 to the exit state of chunk i.
    """
    out = maps.copy()
    reach = 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)
        reach *= 2
    return out


def piece_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pieces begin in a text of character classes."""
    nexts, marks = splitter_tables()
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T).astype(np.int16)
    base = np.arange(N_STATES, dtype=np.uint8)
    maps = np.tile(base, (rows, 1))
    for column in columns:
        index = maps * np.int16(N_CLASSES) + column[:, None]
        maps = nexts[index]
    exits = compose_scan(maps)[:, START]
    state = np.concatenate(([np.uint8(START)], exits[:-1]))
    seen = np.empty((chunk, rows), np.uint8)
    for i, column in enumerate(columns):
        index = state * np.int16(N_CLASSES) + column
        seen[i] = marks[index]
        state = nexts[index]
    flat = seen.T.reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


class _Sizes(dict):
    """Of two bytes that end no token, only the last one is a token."""

    def __missing__(self, tail: bytes) -> list[int]:
        return [1]


class PieceTransducer:
    """Deterministic transducer over the bytes of a piece; states are prefixes.

    The state after a prefix remembers the last tokens of the encodings of all
    its own prefixes, from which the state after one more byte follows: its
    last token is the longest vocabulary entry ending here that the merge order
    keeps apart from the token before it.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        bytes_of = {c: b for b, c in _byte_letters().items()}
        raw = lambda t: bytes(bytes_of[c] for c in t)
        special = {t["content"] for t in spec["added_tokens"]}
        self.vocab = {raw(t) for t in model["vocab"] if t not in special}
        self.longest = max(map(len, self.vocab))
        # sizes of the tokens with the same last bytes, the longest first; any token may be of one byte
        sizes: dict[bytes, set[int]] = {}
        for token in self.vocab:
            sizes.setdefault(token[-2:], set()).add(len(token))
        self.sizes_of = _Sizes({tail: sorted(found | {1}, reverse=True) for tail, found in sizes.items()})
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, merge in enumerate(model["merges"]):
            a, b = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b))
        # only tokens that their own merges build again can end a prefix
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}
        self.kept: dict[str, int] = {}

    def _encode(self, data: bytes) -> list[bytes]:
        """Merges in order of rank, leftmost first; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(
                range(len(parts) - 1),
                key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60),
            )
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens side by side are their own encoding."""
        pair = left, right
        if pair not in self.apart:
            if len(self.apart) > KEPT_STATES:
                self.apart.clear()
            self.apart[pair] = self._encode(left + right) == [left, right]
        return self.apart[pair]

    def _state(self, prefix: bytes) -> tuple[int, bytes]:
        """(tokens of a short prefix, its last token)."""
        found = self.states.get(prefix)
        if found is None:
            found = self._next(prefix, len(prefix), lambda at: self._state(prefix[:at]))
            self.states[prefix] = found
        return found

    def _next(
        self, data: bytes, end: int, state: Callable[[int], tuple[int, bytes]]
    ) -> tuple[int, bytes]:
        """The state after ``end`` bytes, from the states before."""
        for size in self.sizes_of[data[max(0, end - 2) : end]]:
            if size > end:
                continue
            token = data[end - size : end]
            if token not in self.vocab:
                continue
            if size == end:
                if size == 1 or self._encode(token) == [token]:
                    return 1, token
                continue
            count, before = state(end - size)
            if self._stay_apart(before, token):
                return count + 1, token
        raise ValueError("the vocabulary does not hold every byte")

    def _walk(self, data: bytes) -> int:
        """Tokens of a long piece; what is held are the states of its last places alone."""
        states: deque[tuple[int, bytes]] = deque([(0, b"")], maxlen=self.longest)
        for end in range(1, len(data) + 1):
            states.append(self._next(data, end, lambda at, end=end: states[at - end]))
        return states[-1][0]

    def count(self, piece: str) -> int:
        """Tokens of a piece: the sum of the changes along its bytes."""
        found = self.kept.get(piece)
        if found is None:
            data = piece.encode()
            if len(data) > LONG_PIECE:
                return self._walk(data)
            if len(self.states) > KEPT_STATES:
                self.states.clear()
                self.states[b""] = 0, b""
            found = self._state(data)[0]
            if len(self.kept) > KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = found
        return found


@lru_cache
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


def count_tokens(texts: list[str], path: str, classes: np.ndarray) -> np.ndarray:
    """Tokens of each text."""

    def load() -> tuple[PieceTransducer, list[str]]:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return PieceTransducer(spec), [t["content"] for t in spec["added_tokens"]]

    pieces, specials = worker_cache(f"pieces:{path}", load)
    counts = np.zeros(len(texts), np.int64)
    # an unpaired character that no text can hold ends a text or a special token
    whole, ends, owner = [], [], []
    at = 0
    for i, text in enumerate(texts):
        if any(s in text for s in specials):
            segments = regex.split("|".join(map(regex.escape, specials)), text)
            counts[i] += len(segments) - 1
        else:
            segments = [text]
        for segment in segments:
            whole.append(segment)
            at += len(segment)
            ends.append(at)
            owner.append(i)
            at += 1
    joined = "\0".join(whole) + "\0"
    stops = np.array(ends, np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = classes[codes]
    kinds[stops] = END
    starts = piece_starts(kinds)
    if not len(starts):
        return counts
    segment_of = np.searchsorted(stops, starts, side="right")
    finish = np.minimum(np.append(starts[1:], len(joined)), stops[segment_of])
    kept, count = pieces.kept, pieces.count
    each = np.fromiter(
        (
            kept.get(p := joined[a:b]) or count(p)
            for a, b in zip(starts.tolist(), finish.tolist(), strict=True)
        ),
        np.int64,
        len(starts),
    )
    np.add.at(counts, np.array(owner)[segment_of], each)
    return counts


def token_counts(
    docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    A null or empty text has no bytes and no tokens.  Rows are independent:
    nothing is shuffled, repeated ids give repeated rows, other columns are
    not read.  ``over_limit`` is n_tokens > limit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(class_table(path))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(shared.value, np.uint8)
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("n_bytes"),
                    pa.array(count_tokens(texts, path, classes), pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    text = text_or_empty(docs, text_column)
    source = docs.select(
        docs[id_column].alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    id_type = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
