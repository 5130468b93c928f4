"""Packing by concatenating and cutting.

Two passes.  The first tokenises every document and writes its ids with the
number of its partition and its place in it; the token totals of the
partitions are summed to global offsets.  The second pass adds them and cuts the
one long row of ids into windows of fixed length, so a document that a window's
border crosses becomes several pieces.  Nothing is shuffled, no window but the
last is padded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from typeloom.functions.sizing import work_folder
from typeloom.llm.common import released, text_or_empty, text_slices, worker_cache

#: Words whose ids a worker keeps.
KEPT_WORDS = 600_000
#: Words that are encoded as one text.
TOGETHER = 20_000
#: Signs beyond ASCII that are neither letters nor digits; a tokenizer may drop or change them.
ODD_SIGN = re.compile(r"[^!-~\w]")
#: ASCII that Python takes for white space and tokenizers do not drop.
OTHER_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f"
#: Without these, lower-casing the text first changes no id.
NOT_PLAIN = re.compile("<[|]|[İɐ-\U0010ffff]")


class Kept(dict):
    """Ids of words that stay, and of those that are looked up in ``others`` this time."""

    others: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.others[word]


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space and lower-cases.

    Words between white space are encoded once each and kept, until ``KEPT_WORDS`` are there; others
    are encoded in each call anew.  Many words are encoded as one text, which is cut at the
    bytes of their tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = without_normalizer(self.tokenizer)
        self.kept = Kept()
        # Bytes of a token: one for each letter of its name, which may end in a mark of the word's end.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix))

    def _alone(self, words: list[str]) -> Iterator[bytes]:
        for start in range(0, len(words), 10_000):
            part = words[start : start + 10_000]
            for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(found.ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words that the tokenizer's normal form leaves as they are."""
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            found = self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in part])
            reached = np.cumsum(self.sizes[ids])
            cuts = np.searchsorted(reached, ends)
            if cuts[-1] != len(ids) - 1 or not np.array_equal(reached[np.minimum(cuts, len(ids) - 1)], ends):
                yield from self._alone(part)
                continue
            data, at = ids.tobytes(), 0
            for cut in ((cuts + 1) * 4).tolist():
                yield data[at:cut]
                at = cut

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        words = [words_of(text) for text in texts]
        kept = self.kept
        plain, odd = [], []
        for word in set().union(*words).difference(kept):
            (plain if is_plain(word) else odd).append(word)
        fresh = dict(zip(odd, self._alone(odd), strict=True))
        fresh.update(zip(plain, self._together(plain), strict=True))
        # the commonest words are there already, or come now
        kept.update(islice(fresh.items(), max(0, KEPT_WORDS - len(kept))))
        kept.others = fresh
        found = [np.frombuffer(b"".join(map(kept.__getitem__, row)), "<u4") for row in words]
        kept.others = {}
        return found


def without_normalizer(tokenizer: Tokenizer) -> Tokenizer:
    """The same for plain words, without the steps that leave these as they are, where it has no others."""
    steps = json.loads(tokenizer.to_str())["normalizer"]
    steps = steps["normalizers"] if steps and steps["type"] == "Sequence" else [steps]
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if not all(step in (None, {"type": "NFC"}, {"type": "Lowercase"}, blanks) for step in steps):
        return tokenizer
    bare = Tokenizer(tokenizer.model)
    if tokenizer.pre_tokenizer is not None:
        bare.pre_tokenizer = tokenizer.pre_tokenizer
    return bare


def words_of(text: str) -> list[str]:
    """What stands between white space of the kind that every tokenizer here drops, in lower case."""
    if not (NOT_PLAIN.search(text) if not text.isascii() else "<|" in text):
        text = text.lower()
    if text.isascii() and not any(blank in text for blank in OTHER_BLANKS):
        return text.split()
    for blank in "\t\n\r":
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def is_plain(word: str) -> bool:
    """Whether lower-casing and composing characters leave a word as it is, and no special token is in it."""
    if "<|" in word:
        return False
    if word.isascii():
        return word.isprintable() and word == word.lower()
    return not ODD_SIGN.search(word) and word == word.lower() and unicodedata.is_normalized("NFC", word)


def tokenized(
    docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, part, start, n, ids): ids of each text and ``end_id``, little-endian, 4 * n bytes.

    Where all ids of the tokenizer are below 65536 they have 2 bytes each, so half is written.
    ``part`` is the number of the row's partition and ``start`` the count of
    ids before it there.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"words:{path}", lambda: WordEncoder(path))
        part = TaskContext.get().partitionId()
        start = 0
        kind = "<u2" if max(len(encoder.sizes), end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for batch, texts in text_slices(batches):
            rows = encoder.encode(texts)
            ids = [row.astype(kind).tobytes() + end for row in rows]
            sizes = [len(row) + 1 for row in rows]
            starts = list(accumulate(sizes, initial=start))
            start = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["id", "part", "start", "n", "ids"],
            )

    source = docs.select(
        docs[id_column].alias("id"), text_or_empty(docs, text_column).alias("text")
    )
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {id_type}, part int, start long, n long, ids binary")


def concatenate_and_cut(encoded: DataFrame, window: int) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of :func:`tokenized` rows.

    ``encoded`` must be a table that reads the same each time.  The driver holds one
    number a partition, as Spark's own scheduler does; the pieces need no shuffle.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, before = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        bases[row["part"]] = before
        before += row["n"]
    shared = encoded.sparkSession.sparkContext.broadcast(bases)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of = shared.value
        worker_cache("pieces", dict)  # words that this worker may keep are no longer needed
        for batch in (b.slice(i, 500) for b in released(batches) for i in range(0, b.num_rows, 500)):
            rows, starts, lengths, pieces, sequences, offsets = [], [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("part", "start", "n")]
            ids = batch.column("ids")
            for i, (part, start, n) in enumerate(zip(*columns, strict=True)):
                at, end = base_of[part] + start, base_of[part] + start + n
                data, first = ids[i].as_py(), at
                if len(data) == 2 * n:
                    data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                while at < end:
                    stop = min(end, (at // window + 1) * window)
                    rows.append(i)
                    starts.append(at - first)
                    lengths.append(stop - at)
                    pieces.append(data[4 * (at - first) : 4 * (stop - first)])
                    sequences.append(at // window)
                    offsets.append(at % window)
                    at = stop
            taken = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(taken),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(pieces, pa.binary()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    batch.column("n").take(taken),
                    pa.array(sequences, pa.int64()),
                    pa.array(offsets, pa.int64()),
                ],
                ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    id_type = encoded.schema["id"].dataType.simpleString()
    return encoded.mapInArrow(
        cut,
        f"id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long",
    )


def pack(
    docs: DataFrame,
    path: str,
    end_id: int,
    window: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    A null or empty text is its end id alone.  Repeated ids are packed as
    separate documents.  Other columns are not read; an empty table gives no piece.
    All sequences are full but the last one.  The ids are written to the work
    folder, so both passes see the same rows whatever executor is lost.
    """
    spark = docs.sparkSession
    folder = f"{work_folder(spark)}/ids"
    encoded = tokenized(docs, path, end_id, id_column, text_column)
    encoded.write.option("compression", "zstd").parquet(folder)
    return concatenate_and_cut(
        spark.read.schema(encoded.schema).parquet(folder), window
    ).withColumnRenamed("id", id_column)
