"""Near-duplicates by weighted Jaccard similarity of word shingles.

A text is a multiset of five-word shingles.  Its signature comes from Poisson
processes over the weight axis: every shingle has one process on each of the dyadic
stretches [0,1), [1,2), [2,4), ... of the axis, a process is run only where the shingle's
weight reaches and only until all places of the signature are taken, and the earliest point of each
place is the signature's value.  Two signatures agree in a place with the probability
of their weighted Jaccard similarity.

Equal multisets are one text from then on.  Signatures are cut into bands; texts that share a
band are compared exactly on their multisets, and similar ones make up a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin
from typeloom.llm.common import text_or_empty, text_slices, worker_cache
from typeloom.operators.setjoin import connected_components

SHINGLE = 5
BANDS = 20
ROWS = 4
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000
#: Members of a band on either side that one task compares at a time.
BLOCK = 512
#: Shingles whose occurrences are multiplied at a time.
COLUMNS = 2048
#: Salts of joins on keys that many rows may share.
SALTS = 16
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _steps(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) & (1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A random function of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def shingle_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight), by text and hash.

    Words are lower-cased runs without white space; a text of fewer than five words is one
    shingle, a text without words has none.
    """
    kept: dict[str, int] = worker_cache("shingle_words", dict)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    rows = [text.lower().split() for text in texts]
    hashed = xxhash.xxh3_64_intdigest
    for row in rows:
        for word in row:
            if word not in kept:
                kept[word] = hashed(word)
    sizes = np.array([len(r) for r in rows], np.int64)
    get = kept.__getitem__
    words = np.fromiter((h for row in rows for h in map(get, row)), np.uint64, int(sizes.sum()))
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    whole = len(words) - SHINGLE + 1
    if whole > 0:
        shingles = np.zeros(whole, np.uint64)
        for k in range(SHINGLE):
            shingles += mixed(words[k : k + whole] + _steps(k))
        shingles = mixed(shingles)
    docs, hashes = [], []
    for i, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
        if size >= SHINGLE:
            own = np.sort(shingles[begin : begin + size - SHINGLE + 1])
        elif size:
            part = words[begin : begin + size] + np.arange(size, dtype=np.uint64) * _STEP
            own = mixed(mixed(part).sum(keepdims=True) + _steps(size))
        else:
            continue
        hashes.append(own)
        docs.append(np.full(len(own), i, np.int64))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return d[first], h[first], np.diff(np.append(first, len(h)))


def bag_min_hash(
    d: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int, reach: float = 8.0
) -> np.ndarray:
    """uint64 signatures (n, m) of the bags numbered 0 to n - 1; rows without elements are 0.

    Points behind a time that leaves a place empty with probability exp(-reach) are not
    made; bags with an empty place are done again with more.
    """
    out = np.zeros((n, m), np.uint64)
    if not len(d):
        return out
    total = np.bincount(d, weights=w, minlength=n)
    until = np.divide(m * (np.log(m) + reach), total, where=total > 0, out=np.zeros(n))
    stretches = []
    for j in range(int(w.max() - 1).bit_length() + 1):
        low = 0 if j == 0 else 1 << (j - 1)
        at = np.flatnonzero(w > low)
        stretches.append((at, np.full(len(at), j)))
    element = np.concatenate([a for a, _ in stretches])
    level = np.concatenate([j for _, j in stretches])
    low = np.where(level == 0, 0, 2.0 ** (level - 1.0))
    width = np.where(level == 0, 1.0, low)
    share = np.minimum(w[element] - low, width) / width  # of the stretch below the weight
    seed = mixed(h[element] + (level.astype(np.uint64) + np.uint64(1)) * _STEP)
    owner = d[element]
    limit = until[owner]
    time = np.zeros(len(element))
    best = np.full(n * m, np.inf)
    points = []
    active, k = np.arange(len(element)), 0
    while len(active):
        k += 1
        draw = mixed(seed[active] + _steps(k))
        now = time[active] - np.log(uniform(draw)) / width[active]
        time[active] = now
        early = now <= limit[active]
        active, draw, now = active[early], draw[early], now[early]
        value = mixed(draw ^ _C1)
        inside = uniform(mixed(value ^ _C2)) <= share[active]
        place = owner[active][inside] * m + (value[inside] % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, place, now[inside])
        points.append((place, now[inside], value[inside]))
    place, now, value = (np.concatenate(x) for x in zip(*points, strict=True))
    least = now == best[place]
    out.reshape(-1)[place[least]] = value[least]
    open_ = np.isinf(best.reshape(n, m)).any(axis=1) & (total > 0)
    if open_.any():
        again = open_[d]
        out[open_] = bag_min_hash(d[again], h[again], w[again], n, m, 2 * reach + 8)[open_]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 keys (n, bands)."""
    cut = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, cut.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key + cut[:, :, i])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of (sorted hashes, weights)."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][left], b[1][right]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, bag, keys) of ``id, text`` rows; bag is a digest of the multiset, null without words."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            d, h, w = shingle_bags(texts)
            keys = band_keys(bag_min_hash(d, h, w, len(texts), bands * rows), bands, rows)
            ends = np.searchsorted(d, np.arange(len(texts) + 1))
            digests = [
                hashlib.blake2b(h[a:b].tobytes() + w[a:b].tobytes(), digest_size=16).digest()
                if b > a
                else None
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(len(texts) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1))
                    ),
                ],
                ["id", "bag", "keys"],
            )

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {id_type}, bag binary, keys array<long>")


def bags_of(docs: DataFrame) -> DataFrame:
    """(id, hashes, weights) of ``id, text`` rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            d, h, w = shingle_bags(texts)
            ends = np.searchsorted(d, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(w.astype(np.int32))),
                ],
                ["id", "hashes", "weights"],
            )

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(count, f"id {id_type}, hashes array<long>, weights array<int>")


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of the pairs that reach the threshold, on whole bags."""
    a = bags.select(F.col("id").alias("left_id"), F.struct("hashes", "weights").alias("a"))
    b = bags.select(F.col("id").alias("right_id"), F.struct("hashes", "weights").alias("b"))
    both = pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", "a", "b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bag(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
            value = column[i]
            return (
                np.asarray(value["hashes"].values).view(np.uint64),
                np.asarray(value["weights"].values),
            )

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            found = np.array([overlap(bag(a, i), bag(b, i)) for i in range(batch.num_rows)], float)
            keep = pa.array(found >= threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("left_id").filter(keep),
                    batch.column("right_id").filter(keep),
                    pa.array(found).filter(keep),
                ],
                ["left_id", "right_id", "similarity"],
            )

    id_type = bags.schema["id"].dataType.simpleString()
    return both.mapInArrow(compare, f"left_id {id_type}, right_id {id_type}, similarity double")


def overlaps(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarities of all bags of ``a`` with all of ``b``.

    A shingle of weight w is w elements; common elements are counted by products of
    0/1 matrices, ``COLUMNS`` elements at a time.
    """

    def elements(bags: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
        h = np.concatenate([h for h, _ in bags])
        w = np.concatenate([w for _, w in bags]).astype(np.int64)
        each = np.repeat(np.arange(len(h)), w)
        level = np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)
        return row[each], mixed(h[each] + level.astype(np.uint64) * _STEP), np.bincount(row, w, len(bags))

    row_a, of_a, size_a = elements(a)
    row_b, of_b, size_b = elements(b)
    shared = np.intersect1d(of_a, of_b)
    both = np.zeros((len(a), len(b)), np.float32)

    def placed(row: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, of), max(len(shared) - 1, 0))
        known = shared[at] == of if len(shared) else np.zeros(len(of), bool)
        order = np.argsort(at[known], kind="stable")
        return row[known][order], at[known][order]

    row_a, at_a = placed(row_a, of_a)
    row_b, at_b = placed(row_b, of_b)
    for start in range(0, len(shared), COLUMNS):
        dense = []
        for row, at, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            cut = slice(*np.searchsorted(at, (start, start + COLUMNS)))
            x = np.zeros((n, COLUMNS), np.float32)
            x[row[cut], at[cut] - start] = 1
            dense.append(x)
        both += dense[0] @ dense[1].T
    return both / (size_a[:, None] + size_b[None, :] - both)


def _spanning(left: np.ndarray, right: np.ndarray, components: np.ndarray) -> list[int]:
    """Numbers of the pairs that join components not yet joined by pairs before them."""
    above: dict = {}

    def top(x):
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = top(components[a]), top(components[b])
        if a != b:
            above[b] = a
            kept.append(i)
    return kept


def _within_blocks(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (left_id, right_id, similarity) between components that share a band.

    ``members`` are (key, id, component).  All members of a band are compared with those
    outside the band's largest component, exactly and on whole bags.  Both
    sides are dealt into blocks of about ``BLOCK`` members, a block of one meets a block of
    the other in a task, and of the links that it finds those leave it that join
    components not yet joined there.
    """
    largest = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"),
        F.sum("n").alias("all"),
        (F.sum("n") - F.max("n")).alias("others"),
    )
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sized = members.join(
        pin(largest.select("key", "largest", blocks("all").alias("all"), blocks("others").alias("others"))),
        "key",
    )
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = (
        sized.filter("component <> largest")
        .select("key", "id", "component", F.lit(True).alias("few"), block("others").alias("i"), each("all").alias("j"))
    )
    all_ = sized.select(
        "key", "id", "component", F.lit(False).alias("few"), block("all").alias("j"), each("others").alias("i")
    )
    dealt = few.unionByName(all_).join(bags, "id")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        few = rows["few"].to_numpy()
        bags = [
            (np.asarray(h.values).view(np.uint64), np.asarray(w.values))
            for h, w in zip(rows["hashes"], rows["weights"], strict=True)
        ]
        a, b = np.flatnonzero(few), np.flatnonzero(~few)
        components = rows["component"].to_numpy()
        if len(a) and len(b):
            found = overlaps([bags[i] for i in a], [bags[i] for i in b])
            found[components[a][:, None] == components[b][None, :]] = 0
            x, y = np.nonzero(found >= threshold)
            kept = _spanning(a[x], b[y], components)
            x, y = x[kept], y[kept]
        else:
            found, x, y = np.zeros((1, 1)), np.zeros(0, int), np.zeros(0, int)
        return pa.table(
            {
                "left_id": rows["id"].take(pa.array(a[x])),
                "right_id": rows["id"].take(pa.array(b[y])),
                "similarity": pa.array(found[x, y].astype(float)),
            }
        )

    id_type = bags.schema["id"].dataType.simpleString()
    return dealt.groupBy("key", "i", "j").applyInArrow(
        compare, f"left_id {id_type}, right_id {id_type}, similarity double"
    )


def _open_bands(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members, with components, of the bands that hold several components."""
    placed = pin(members.join(components, "id"))
    several = pin(
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("key")
    )
    return pin(placed.join(several, "key"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, class_id, n_copies, n_class, representative) of every row of ``docs``.

    ``class_id`` is the least id of the texts that a chain of similarities of at
    least ``threshold`` joins, ``n_copies`` the rows with the same multiset of shingles,
    ``n_class`` the rows of the class; ``representative`` holds where id = class_id.

    Two texts of similarity s share a band with probability 1 - (1 - s**rows)**bands.  Texts of a
    band are first compared with its least member; where this leaves several components, the
    texts outside the largest are compared with all of the band, in blocks.
    Texts without words are alone in their class, rows without id have null for a
    class; rows that share an id and a text share a class.
    """
    m = bands * rows
    source = docs.select(
        docs[id_column].alias("id"), text_or_empty(docs, text_column).alias("text")
    )
    hashed = pin(signed(source, bands, rows))
    known = hashed.filter(F.col("id").isNotNull() & F.col("bag").isNotNull())
    texts = pin(
        known.groupBy("bag")
        .agg(F.min(F.struct("id", "keys")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
        .select("bag", "first.id", "first.keys", "n_copies")
    )
    keys = texts.select("id", F.explode("keys").alias("key"))
    shared = pin(
        keys.groupBy("key")
        .agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", "leader")
    )
    met = pin(keys.join(shared, "key"))
    members = met.select("key", "id")
    ids = pin(members.select("id").distinct())
    bags = pin(bags_of(source.join(ids, "id", "left_semi")).dropDuplicates(["id"]))
    star = pin(
        met.filter("id <> leader")
        .select(F.col("leader").alias("left_id"), F.col("id").alias("right_id"))
        .distinct()
    )
    links = pin(verified(star, bags, threshold))
    components = connected_components(ids, links)
    open_ = _open_bands(members, components)
    if open_.limit(1).count():
        more = pin(_within_blocks(open_, bags, threshold))
        if more.limit(1).count():
            components = connected_components(ids, links.unionByName(more))
    classed = pin(
        texts.drop("keys")
        .join(components, "id", "left")
        .select("bag", "n_copies", F.coalesce("component", "id").alias("class_id"))
    )
    sizes = pin(classed.groupBy("class_id").agg(F.sum("n_copies").alias("n_class")))
    by_bag = pin(classed.join(sizes, "class_id"))
    # a text that a third of all rows share meets its class in SALTS groups
    salted = by_bag.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = (
        hashed.select("id", "bag")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["bag", "salt"], "left")
    )
    alone = F.col("bag").isNull() & F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id"))
        .otherwise(F.when(F.col("id").isNotNull(), F.col("class_id")))
        .alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"),
    ).withColumn("representative", F.col(id_column).eqNullSafe(F.col("class_id")))


def drop_near_duplicates(
    docs: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """One row of ``docs`` for each class: that with the class's least id.

    Of rows that share this id and their text one stays.  Rows without id stay.
    """
    found = near_duplicates(docs, threshold, id_column=id_column, text_column=text_column, **options)
    kept = pin(
        found.filter(F.col("representative") & F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("_kept"))
        .distinct()
    )
    with_id = docs.join(kept, docs[id_column] == kept["_kept"], "left_semi").dropDuplicates(
        [id_column, text_column]
    )
    return with_id.unionByName(docs.filter(F.col(id_column).isNull()))
