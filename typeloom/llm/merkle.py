"""A Merkle manifest of a table, with a proof for every row by pointer jumping.

Rows are leaves of one tree a group, the groups' roots leaves of one tree above
them; every ``FAN`` consecutive nodes have a parent, whose digest is the SHA-256 of theirs
as hex text.  A node's *segment* is the digests of its siblings, then of its
ancestors' siblings, as far up as its pointer reaches.  At first every node points to its
parent.  In each round the nodes are joined with the nodes they point to, take over
their pointers and append their segments, so that the distance doubles: a tree of
depth n takes log2(n) joins.  The levels that no later round looks at are left out.

Below an ancestor at distance d there are up to 3**d nodes.  So that no ancestor is
the join key of a whole tree it is joined in copies, each for a stretch of at most
3**``SHARED`` nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import work_folder
from typeloom.llm.common import ranked, sql_crc32

FAN = 3
#: Levels that one pass builds; a block of FAN**LEVELS nodes is held at a time.
LEVELS = 5
#: A copy of an ancestor is joined with at most FAN**SHARED nodes.
SHARED = 7
DIGEST = 32


def digest_of(*columns: Column) -> Column:
    """Hex SHA-256 over fields: ``-`` for a null, else UTF-8 byte count, ``:`` and the value."""
    fields = []
    for column in columns:
        value = column.cast("string")
        named = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        fields.append(F.when(column.isNull(), F.lit("-")).otherwise(named))
    return F.sha2(F.concat(*fields), 256)


def parent_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def depth_of(size: int) -> int:
    """Levels above the leaves of a tree with ``size`` leaves."""
    depth = 0
    while size > 1:
        size, depth = (size + FAN - 1) // FAN, depth + 1
    return depth


def fold(digest: bytes, segment: bytes, places: Iterable[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings give; ``places``: (rank, size) in each tree, lowest first."""
    at = 0
    for rank, size in places:
        while size > 1:
            first = rank - rank % FAN
            own = rank % FAN * DIGEST
            end = at + (min(FAN, size - first) - 1) * DIGEST
            siblings, at = segment[at:end], end
            digest = parent_digest([siblings[:own], digest, siblings[own:]])
            rank, size = rank // FAN, (size + FAN - 1) // FAN
    return digest


def _built(level: int, rank: int, size: int, digests: list[bytes]) -> Iterator[tuple]:
    """(level, rank, digest, segment) of the nodes of one block, from ``level`` upwards.

    The digests are those of consecutive nodes; ``size`` counts the nodes of the tree on that level.  The
    topmost node is given without a segment, unless it is the root.
    """
    top = level + LEVELS
    while size > 1 and level < top:
        above = []
        for i in range(0, len(digests), FAN):
            run = digests[i : i + FAN]
            above.append(parent_digest(run))
            for j, own in enumerate(run):
                yield level, rank + i + j, own, b"".join(run[:j] + run[j + 1 :])
        digests, level, rank, size = above, level + 1, rank // FAN, (size + FAN - 1) // FAN
    for own in digests:
        yield level, rank, own, b"" if size == 1 else None


def _tree(leaves: DataFrame, payload: list[str], deepest: int, folder: str) -> DataFrame:
    """All nodes (grp, level, rank, leaves, depth, digest, segment, payload) above ranked leaves."""
    fields = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in payload)
    schema = (
        "grp string, level int, rank long, leaves long, depth int, digest binary, segment binary"
        + (f", {fields}" if fields else "")
    )
    types = {c: None for c in payload}

    def build(low: int):
        def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["grp", "rank", "leaves", "digest", *payload]
            key, rows, out = None, [], []

            def closed() -> Iterator[tuple]:
                grp, _, size = rows[0][0], rows[0][1], rows[0][2]
                depth, at = depth_of(size), size
                for _ in range(low):
                    at = (at + FAN - 1) // FAN
                for level, rank, digest, segment in _built(low, rows[0][1], at, [r[3] for r in rows]):
                    held = rows[rank - rows[0][1]][4:] if level == low else (None,) * len(payload)
                    yield (grp, level, rank, size, depth, digest, segment, *held)

            def flushed() -> pa.RecordBatch:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                kinds += [types[c] for c in payload]
                columns = zip(*out, strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays(
                    arrays, ["grp", "level", "rank", "leaves", "depth", "digest", "segment", *payload]
                )

            for batch in batches:
                for c in payload:
                    types[c] = batch.schema.field(c).type
                for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    now = (row[0], row[1] // FAN**LEVELS)
                    if now != key and rows:
                        out.extend(closed())
                        rows = []
                        if len(out) >= 10_000:
                            yield flushed()
                    key = now
                    rows.append(row)
            if rows:
                out.extend(closed())
            if out:
                yield flushed()

        return blocks

    spark, open_nodes, found = leaves.sparkSession, leaves, None
    for low in range(0, max(deepest, 1), LEVELS):
        placed = open_nodes.repartition("grp", F.expr(f"rank div {FAN**LEVELS}"))
        placed = placed.sortWithinPartitions("grp", "rank").mapInArrow(build(low), schema)
        placed.write.parquet(f"{folder}/{low}")
        placed = spark.read.schema(schema).parquet(f"{folder}/{low}")
        open_nodes = placed.filter("segment is null")
        done = placed.filter("segment is not null")
        found = done if found is None else found.unionByName(done)
    return found


def _jumped(nodes: DataFrame, payload: list[str], deepest: int, folder: str) -> DataFrame:
    """The leaves of ``nodes`` with the segments up to the roots of their trees."""
    spark, distance = nodes.sparkSession, 1
    while distance < deepest:
        shared = min(distance, SHARED)
        copies = FAN ** (distance - shared)
        stretch = F.expr(f"rank div {FAN**shared}")
        short = nodes.filter(F.col("level") % (2 * distance) == 0)
        jumps = F.col("level") + distance < F.col("depth")
        # The last node, on the level below, under an ancestor: the tree may end before.
        last = F.expr(
            f"(cast(ceil(leaves / power({FAN}, level - {distance})) as bigint) - 1) div {FAN**shared}"
        )
        first = F.col("rank") * copies
        ancestors = nodes.filter(
            (F.col("level") % (2 * distance) == distance) & (F.col("level") < F.col("depth"))
        ).select(
            "grp",
            (F.col("level") - distance).alias("level"),
            F.explode(F.sequence(first, F.least(first + copies - 1, last))).alias("stretch"),
            F.col("segment").alias("further"),
        )
        moved = (
            short.filter(jumps)
            .withColumn("stretch", stretch)
            .join(ancestors, ["grp", "level", "stretch"])
            .withColumn("segment", F.concat("segment", "further"))
            .drop("stretch", "further")
        )
        nodes = short.filter(~jumps).unionByName(moved)
        nodes.write.parquet(f"{folder}/{distance}")
        nodes = spark.read.schema(nodes.schema).parquet(f"{folder}/{distance}")
        distance *= 2
    return nodes.filter("level = 0").drop("level", "depth")


def proofs(leaves: DataFrame, payload: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Segments of ranked leaves (grp, rank, size, digest, payload), and the root of each group.

    The first frame has (grp, rank, leaves, digest, segment, payload), the second (grp, leaves, digest).
    """
    leaves = leaves.withColumnRenamed("size", "leaves")
    deepest = depth_of(leaves.agg(F.max("leaves")).first()[0] or 0)
    nodes = _tree(leaves, payload, deepest, f"{folder}/tree")
    roots = nodes.filter("level = depth").select("grp", "leaves", "digest")
    return _jumped(nodes, payload, deepest, f"{folder}/jumps"), roots


def manifest(
    leaves: DataFrame, id_column: str, group_column: str, leaf_column: str, other_column: str | None = None
) -> DataFrame:
    """One row a leaf: (id, leaf, subroot, root, proof, folded_root, verified).

    ``leaf_column`` holds hex digests; leaves ascend by id in their group, groups by name, nulls
    first.  ``proof`` lists the siblings from the leaf to the root as binary digests.
    ``folded_root`` is what ``other_column``, a digest to be checked, gives with them (by default, or where
    it is null, the leaf itself); ``verified`` says whether that is the root.

    Rows that share an id are leaves of their own, ordered by digest; other columns
    are not read; an empty table gives no row.  Every table between two steps lies in
    the work folder.
    """
    spark, folder = leaves.sparkSession, work_folder(leaves.sparkSession)
    other = F.lit(None).cast("string") if other_column is None else leaves[other_column]
    group = leaves[group_column].cast("string")
    taken = leaves.select(
        leaves[id_column].alias("id"),
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),
        F.unhex(leaves[leaf_column]).alias("digest"),
        F.when(other != leaves[leaf_column], F.unhex(other)).alias("other"),
        F.monotonically_increasing_id().alias("uniq"),
    )
    taken.write.parquet(f"{folder}/leaves")
    taken = spark.read.schema(taken.schema).parquet(f"{folder}/leaves")
    order = ["id", "digest", "other", "uniq"]
    placed = ranked(taken, ["grp"], order, f"{folder}/ranked").drop("uniq")
    found, subroots = proofs(placed, ["id", "other"], f"{folder}/groups")

    named = subroots.withColumnRenamed("grp", "name").withColumnRenamed("leaves", "members")
    groups = ranked(named.withColumn("grp", F.lit("")), ["grp"], ["name"], f"{folder}/names")
    above, root = proofs(groups, ["name", "members"], f"{folder}/above")
    stretch = F.expr(f"rank div {FAN**SHARED}")
    top = root.first()
    above = above.select(
        F.col("name").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.expr(f"(members - 1) div {FAN**SHARED}"))).alias("stretch"),
        F.col("digest").alias("subroot"),
        F.col("rank").alias("group_rank"),
        F.col("leaves").alias("groups"),
        F.col("segment").alias("further"),
        F.lit(top and bytes(top["digest"])).cast("binary").alias("root"),
    )
    whole = found.withColumn("stretch", stretch).join(above, ["grp", "stretch"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rank", "leaves", "group_rank", "groups", "digest", "other", "segment", "further"]
        for batch in batches:
            out, proven = [], []
            for rank, size, group_rank, groups, leaf, other, lower, upper in zip(
                *(batch.column(c).to_pylist() for c in names), strict=True
            ):
                out.append(fold(other or leaf, lower + upper, [(rank, size), (group_rank, groups)]))
                proven.append(lower + upper)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "digest", "subroot", "root")),
                    pa.array(proven, pa.binary()),
                    pa.array(out, pa.binary()),
                ],
                ["id", "leaf", "subroot", "root", "proof", "folded_root"],
            )

    id_type = taken.schema["id"].dataType.simpleString()
    columns = ["id", "digest", "subroot", "root", "rank", "leaves", "group_rank", "groups", "other"]
    checked = whole.select(*columns, "segment", "further").mapInArrow(
        check, f"id {id_type}, leaf binary, subroot binary, root binary, proof binary, folded_root binary"
    )
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    folded = F.lower(F.hex("folded_root")).alias("folded_root")
    return checked.select(
        F.col("id").alias(id_column),
        *hexed,
        "proof",
        folded,
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_digest(*columns: str) -> str:
    fields = (f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns)
    return f"sha256({' || '.join(fields)})"


def _sql_tree(name: str, leaves: str) -> str:
    """Recursive CTE of all nodes above ``leaves`` (grp, i, n, h), and one of their siblings."""
    return f"""
{name} as (
  select grp, 0 as level, i, n, h from {leaves}
  union all
  select grp, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by i))
  from {name} where n > 1 group by grp, level, i // 3
),
{name}_beside as (
  select grp, level, i, coalesce(string_agg(h, '') over (
      partition by grp, level, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (
      partition by grp, level, i // 3 order by i rows between 1 following and unbounded following), '') as r
  from {name}
)"""


def _sql_walk(name: str, tree: str, start: str) -> str:
    """Recursive CTE: the digest ``x`` of each row of ``start`` folded upwards, and its proof."""
    return f"""
{name} as (
  select id, grp, 0 as level, i, n, x, proof from {start}
  union all
  select w.id, w.grp, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(s.l || w.x || s.r),
    w.proof || s.l || s.r
  from {name} w join {tree}_beside s on s.grp = w.grp and s.level = w.level and s.i = w.i
  where w.n > 1
)"""


ORACLE_SQL = f"""
with recursive leaves as (
  select doc_id as id, coalesce('=' || source, '') as grp,
    row_number() over (partition by source order by doc_id) - 1 as i,
    count(*) over (partition by source) as n,
    {_sql_digest("doc_id", "source", "lang", "n_chars", "text")} as h,
    case when {sql_crc32("doc_id::varchar")} % 2 = 0
      then {_sql_digest("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} end as changed
  from documents
), {_sql_tree("low", "leaves")},
subroots as (
  select '' as grp, grp as name, row_number() over (order by grp) - 1 as i, count(*) over () as n, h
  from low where n = 1
), {_sql_tree("top", "subroots")},
started as (select id, grp, i, n, coalesce(changed, h) as x, '' as proof from leaves),
{_sql_walk("walked", "low", "started")},
over as (
  select w.id, s.grp, s.i, s.n, w.x, w.proof, s.h as subroot
  from walked w join subroots s on s.name = w.grp where w.n = 1
), {_sql_walk("topped", "top", "over")}
select t.id as doc_id, l.h as leaf, o.subroot, r.h as root, sha256(t.proof) as proof_sha256,
  t.x as folded_root, t.x = r.h as verified
from topped t join over o on o.id = t.id join leaves l on l.id = t.id
  cross join (select h from top where n = 1) r
where t.n = 1
"""
