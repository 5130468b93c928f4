"""A prefix trie of conversations, and totals of its subtrees by tree contraction.

A node is a distinct sequence of first turns.  It is named by a sum over its turns,
digest times B**position in two prime fields, so the prefixes of a conversation
of any length come from running sums, and a conversation of which the
first turns are replaced needs no new sum: the difference of the two heads is added.

Totals come by rounds of parallel contraction.  *Compress*: chains of nodes with
one child double their pointers till each node points to the chain's end and holds the sum
before it; the end takes the place of the chain, with the sum as toll on its way up.  *Rake*:
leaves are final, their totals go to their parents.  Each round leaves less than half of
the nodes.  Re-expansion goes back through the rounds and gives each contracted node its sum
and the total of its chain's end.

No parent is a join key of all its children: what goes up is aggregated, what goes
down is joined in copies, each for ``SHARED`` children, turns or places in a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from typeloom.functions.sizing import work_folder
from typeloom.llm.common import ranked, sql_crc32

PRIME = 2**61 - 1
BASES = tuple(
    int.from_bytes(hashlib.sha256(name).digest()[:7], "big") for name in (b"first lane", b"second lane")
)
#: Rows that one copy of a row is joined with.
SHARED = 4096
#: Turns whose running sums one window makes.
STRETCH = 1024
#: Characters of decimal ids that are hashed from one row.
ID_CHARS = 4000


class Written:
    """Tables of one run below a folder, so that each step reads what the last one wrote."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = work_folder(self.spark)
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count}_{name}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _copies(rows: Column) -> Column:
    """0, 1, ... for each stretch of ``SHARED`` rows of a count of at least one."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor((rows - 1) / SHARED)))


def _stretch(rank: Column) -> Column:
    return F.floor(rank / SHARED)


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv, turn, mark, chars, uniq): turns as digests; rows without a conversation id are left out."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        conversations["conv_id"].cast("long").alias("conv"),
        conversations["turn"].alias("turn"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("mark"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("uniq"),
    ).filter("conv is not null")


def running_sums(placed: DataFrame, written: Written) -> DataFrame:
    """(conv, at, size, chars, t1, t2, s1, s2): terms of the turns, places from 1, and their running sums."""

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = BASES
        for batch in batches:
            ranks = batch.column("rank").to_pylist()
            marks = batch.column("mark").to_pylist()
            one, two = [], []
            for rank, mark in zip(ranks, marks, strict=True):
                one.append((int.from_bytes(mark[:8], "big") + 1) * pow(first, rank + 1, PRIME) % PRIME)
                two.append((int.from_bytes(mark[8:], "big") + 1) * pow(second, rank + 1, PRIME) % PRIME)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv", "rank", "size", "chars")),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                ],
                ["conv", "rank", "size", "chars", "t1", "t2"],
            )

    schema = "conv long, rank long, size long, chars long, t1 long, t2 long"
    rows = placed.mapInArrow(terms, schema).withColumn("bucket", F.floor(F.col("rank") / STRETCH))
    own = Window.partitionBy("conv", "bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    exact = {c: F.col(c).cast("decimal(20,0)") for c in ("t1", "t2")}
    rows = rows.select("*", *(F.sum(v).over(own).alias(f"s{c[1]}") for c, v in exact.items()))
    rows = written(rows, "sums")
    # A conversation of more than one stretch takes up the sums of those before.
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.filter((F.col("rank") % STRETCH == STRETCH - 1) | (F.col("rank") == F.col("size") - 1))
    ends = ends.filter(F.col("size") > STRETCH).select("conv", "bucket", "s1", "s2")
    bases = ends.select("conv", "bucket", *(F.sum(c).over(before).alias(f"b{c[1]}") for c in ("s1", "s2")))
    whole = rows.join(bases, ["conv", "bucket"], "left")
    return whole.select(
        "conv",
        (F.col("rank") + 1).alias("at"),
        "size",
        "chars",
        "t1",
        "t2",
        *(
            F.expr(f"cast(pmod(s{i} + coalesce(b{i}, 0), {PRIME}) as bigint)").alias(f"s{i}")
            for i in (1, 2)
        ),
    )


def rebuilt(turns: DataFrame, group: int, heads: int, written: Written) -> DataFrame:
    """Places of the rebuilt conversations: (conv, depth, k1, k2, p1, p2, chars, ends).

    ``k1, k2`` name the node, ``p1, p2`` its parent; ``ends`` marks a conversation's last turn.  The
    first crc32(id) % ``heads`` turns are those of the conversation id - id % ``group``.
    """
    head = turns.filter(F.col("at") < heads).groupBy("conv").agg(
        F.max("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("at", "s1", "s2", "chars"))).alias("first"),
    )
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    plan = head.select(
        "conv", "size", "first", taken.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")
    ).join(
        head.select(F.col("conv").alias("base"), F.col("first").alias("given")), "base", "left"
    )
    # Turns that the base gives, and the sums at the end of both heads.
    plan = plan.withColumn(
        "given", F.slice(F.coalesce("given", F.array().cast(plan.schema["given"].dataType)), 1, F.col("h").cast("int"))
    ).withColumn("j", F.size("given").cast("long"))
    kept = F.least("h", "size").cast("int")
    zero = F.lit(0).cast("long")
    plan = written(
        plan.select(
            "conv",
            "size",
            "h",
            "j",
            "given",
            (F.col("j") + F.greatest(zero, F.col("size") - F.col("h"))).alias("depth"),
            *(
                F.when(F.col("j") > 0, F.get("given", F.col("j").cast("int") - 1)[f"s{i}"])
                .otherwise(zero)
                .alias(f"g{i}")
                for i in (1, 2)
            ),
            *(F.when(kept > 0, F.get("first", kept - 1)[f"s{i}"]).otherwise(zero).alias(f"o{i}") for i in (1, 2)),
        ),
        "plans",
    )
    top = plan.select(
        "conv",
        zero.alias("place"),
        *(zero.alias(c) for c in ("k1", "k2")),
        *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")),
        zero.alias("chars"),
        (F.col("depth") == 0).alias("ends"),
    )
    given = plan.filter("j > 0").select("conv", "depth", "given", F.posexplode("given").alias("i", "turn")).select(
        "conv",
        (F.col("i") + 1).cast("long").alias("place"),
        *(F.col(f"turn.s{i}").alias(f"k{i}") for i in (1, 2)),
        *(F.when(F.col("i") > 0, F.get("given", F.col("i") - 1)[f"s{i}"]).otherwise(zero).alias(f"p{i}") for i in (1, 2)),
        "turn.chars",
        (F.col("i") + 1 == F.col("depth")).alias("ends"),
    )
    copies = plan.filter("size > h").select(
        "conv", "h", "j", "g1", "g2", "o1", "o2", "depth", _copies(F.col("size")).alias("stretch")
    )
    own = turns.withColumn("stretch", _stretch(F.col("at") - 1)).join(copies, ["conv", "stretch"])
    own = own.filter("at > h").select(
        "conv", "at", "chars", "h", "j", "t1", "t2", "s1", "s2", "g1", "g2", "o1", "o2", "depth"
    )

    def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = {}
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = {n: [] for n in ("k1", "k2", "p1", "p2")}
            places = []
            for row in zip(*(c[n] for n in ("at", "h", "j")), strict=True):
                places.append(row[0] - row[1] + row[2])
            for i, base in enumerate(BASES, 1):
                lanes = zip(c["h"], c["j"], *(c[f"{n}{i}"] for n in "tsgo"), strict=True)
                for h, j, term, own_sum, given_sum, own_head in lanes:
                    by = shifts.get((i, j - h))
                    if by is None:
                        by = shifts[(i, j - h)] = pow(base, j - h, PRIME)
                    key = (given_sum + by * (own_sum - own_head)) % PRIME
                    out[f"k{i}"].append(key)
                    out[f"p{i}"].append((key - by * term) % PRIME)
            ends = [p == d for p, d in zip(places, c["depth"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"),
                    pa.array(places, pa.int64()),
                    *(pa.array(out[n], pa.int64()) for n in ("k1", "k2", "p1", "p2")),
                    batch.column("chars"),
                    pa.array(ends, pa.bool_()),
                ],
                ["conv", "place", "k1", "k2", "p1", "p2", "chars", "ends"],
            )

    own = own.mapInArrow(
        moved, "conv long, place long, k1 long, k2 long, p1 long, p2 long, chars long, ends boolean"
    )
    return top.unionByName(given).unionByName(own).withColumnRenamed("place", "depth")


def id_digests(members: DataFrame, written: Written) -> DataFrame:
    """(k1, k2, ends_sha256) over the sorted ids (k1, k2, conv) of each node, comma-joined.

    SHA-256 takes its text in order.  The ids are sorted by range and written out as stretches of
    text, so a node at which a third of all conversations end is some rows of text
    for the task that hashes it, which reads them one after another.
    """
    keys = ["k1", "k2", "conv"]

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, held = None, None, [], 0
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                if (k1, k2) != node or held >= ID_CHARS:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, held = (k1, k2), conv, [], 0
                ids.append(str(conv))
                held += len(ids[-1]) + 1
            yield _id_rows(out)
        if ids:
            yield _id_rows([(*node, first, ",".join(ids))])

    def _id_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "first", "ids"]
        )

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _hash_rows(out)
        if node:
            yield _hash_rows([(*node, state.hexdigest())])

    def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)],
            ["k1", "k2", "ends_sha256"],
        )

    placed = members.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = placed.mapInArrow(texts, "k1 long, k2 long, first long, ids string")
    runs = runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return runs.mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _compressed(active: DataFrame, written: Written) -> tuple[DataFrame, DataFrame]:
    """Chains (k1, k2, e1, e2, w, l, steps) of ``active``, and its other nodes in their chains' places."""
    state = active.filter("kids = 1").select(
        "k1",
        "k2",
        F.col("only.k1").alias("e1"),
        F.col("only.k2").alias("e2"),
        (F.col("w") + F.col("only.toll_w")).alias("w"),
        (F.col("l") + F.col("only.toll_l")).alias("l"),
        F.lit(1).cast("long").alias("steps"),
        "p1",
        "p2",
        "toll_w",
        "toll_l",
    )
    state = written(state, "chains")
    done, going = None, state
    while True:
        ahead = state.select(
            F.col("k1").alias("e1"),
            F.col("k2").alias("e2"),
            *(F.col(c).alias(f"{c}_") for c in ("e1", "e2", "w", "l", "steps")),
        )
        joined = written(going.join(ahead, ["e1", "e2"], "left"), "doubled")
        at_end = joined.filter("e1_ is null").select(state.columns)
        done = at_end if done is None else done.unionByName(at_end)
        going = joined.filter("e1_ is not null").select(
            "k1",
            "k2",
            F.col("e1_").alias("e1"),
            F.col("e2_").alias("e2"),
            *((F.col(c) + F.col(f"{c}_")).alias(c) for c in ("w", "l", "steps")),
            "p1",
            "p2",
            "toll_w",
            "toll_l",
        )
        if going.isEmpty():
            break
        state = done.unionByName(going)
    heads = done.groupBy(F.col("e1").alias("k1"), F.col("e2").alias("k2")).agg(
        F.max_by(F.struct("p1", "p2", "toll_w", "toll_l", "w", "l"), "steps").alias("head")
    )
    rest = active.filter("kids != 1").drop("only").join(heads, ["k1", "k2"], "left")
    passed = F.col("head").isNotNull()
    rest = rest.select(
        "k1",
        "k2",
        "kids",
        "w",
        "l",
        *(F.when(passed, F.col(f"head.{c}")).otherwise(F.col(c)).alias(c) for c in ("p1", "p2")),
        *(
            F.when(passed, F.col(f"head.toll_{c}") + F.col(f"head.{c}"))
            .otherwise(F.col(f"toll_{c}"))
            .alias(f"toll_{c}")
            for c in "wl"
        ),
    )
    return done.select("k1", "k2", "e1", "e2", "w", "l", "steps"), rest


def subtree_totals(nodes: DataFrame, written: Written) -> DataFrame:
    """(k1, k2, w, l): sums of ``w`` and ``l`` over the subtree of each node (k1, k2, p1, p2, w, l).

    A root has null for its parent.
    """
    zero = F.lit(0).cast("long")
    active = nodes.select("k1", "k2", "p1", "p2", "w", "l", zero.alias("toll_w"), zero.alias("toll_l"))
    rounds = []
    while True:
        kids = active.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count("*").alias("kids"), F.max(F.struct("k1", "k2", "toll_w", "toll_l")).alias("only")
        )
        active = written(
            active.join(kids, ["k1", "k2"], "left").withColumn("kids", F.coalesce("kids", zero)), "active"
        )
        chains, rest = _compressed(active, written)
        rest = written(rest, "rest")
        leaves = rest.filter("kids = 0")
        rounds.append((chains, leaves.select("k1", "k2", "w", "l")))
        branching = rest.filter("kids > 0")
        if branching.isEmpty():
            break
        gains = leaves.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.sum(F.col("w") + F.col("toll_w")).alias("gain_w"), F.sum(F.col("l") + F.col("toll_l")).alias("gain_l")
        )
        active = branching.join(gains, ["k1", "k2"], "left").select(
            "k1",
            "k2",
            "p1",
            "p2",
            (F.col("w") + F.coalesce("gain_w", zero)).alias("w"),
            (F.col("l") + F.coalesce("gain_l", zero)).alias("l"),
            "toll_w",
            "toll_l",
        )
    totals = None
    for chains, leaves in reversed(rounds):
        totals = leaves if totals is None else totals.unionByName(leaves)
        lengths = chains.groupBy("e1", "e2").agg(F.max("steps").alias("length"))
        ends = totals.join(lengths, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2"))).select(
            "e1",
            "e2",
            F.col("w").alias("end_w"),
            F.col("l").alias("end_l"),
            _copies(F.col("length")).alias("stretch"),
        )
        opened = chains.withColumn("stretch", _stretch(F.col("steps") - 1)).join(ends, ["e1", "e2", "stretch"])
        opened = opened.select(
            "k1", "k2", (F.col("w") + F.col("end_w")).alias("w"), (F.col("l") + F.col("end_l")).alias("l")
        )
        totals = totals.unionByName(written(opened, "opened"))
    return totals


def prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points of last texts that the members after the first share, over the subtree), ends_sha256.

    Turns go by number, nulls first, equal ones by the digest of role and text; repeated rows
    are turns of their own.  Null roles and texts are empty; rows without a conversation id
    belong to none.  Other columns are not read.  An empty table has no node.
    """
    written = Written(conversations)
    turns = written(turn_table(conversations), "turns")
    placed = ranked(turns, ["conv"], ["turn", "mark", "uniq"], written.path("ranked"))
    sums = running_sums(placed.select("conv", "rank", "size", "mark", "chars"), written)
    members = written(rebuilt(sums, group, heads, written), "members")
    nodes = members.groupBy("k1", "k2").agg(
        F.max("depth").alias("depth"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.min("conv").alias("conv_id"),
        F.max("chars").alias("chars"),
    )
    nodes = written(nodes, "nodes")
    parent = [F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    kids = nodes.filter("p1 is not null").groupBy(*parent).agg(F.count("*").alias("n_children"))
    nodes = written(
        nodes.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
        "family",
    )
    totals = subtree_totals(
        nodes.select(
            "k1",
            "k2",
            "p1",
            "p2",
            ((F.col("n_convs") - 1) * F.col("chars")).alias("w"),
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("l"),
        ),
        written,
    )
    # Children are numbered below their parent, which is joined in copies.
    below = nodes.filter("p1 is not null").select("p1", "p2", "k1", "k2")
    below = ranked(below, ["p1", "p2"], ["k1", "k2"], written.path("below"))
    above = nodes.filter("n_children > 0").select(
        F.col("k1").alias("p1"),
        F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
        _copies(F.col("n_children")).alias("stretch"),
    )
    named = below.withColumn("stretch", _stretch(F.col("rank"))).join(above, ["p1", "p2", "stretch"])
    digests = id_digests(members.filter("ends"), written)
    nothing = hashlib.sha256(b"").hexdigest()
    found = nodes.join(totals, ["k1", "k2"])
    found = found.join(named.select("k1", "k2", "parent_conv_id"), ["k1", "k2"], "left")
    return found.join(digests, ["k1", "k2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("l").alias("n_leaves"),
        F.col("w").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


ORACLE_SQL = f"""
with original as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as r
  from conversations where conv_id is not null
),
convs as (select distinct c, {sql_crc32("c::varchar")} % 6 as h from original),
rebuilt as (
  select v.c, o.r as d, o.role, o.text from convs v join original o on o.c = v.c - v.c % 100 where o.r <= v.h
  union all
  select v.c, o.r - v.h + least(v.h, (select count(*) from original b where b.c = v.c - v.c % 100)),
    o.role, o.text
  from convs v join original o on o.c = v.c where o.r > v.h
),
places as (
  select c, 0 as d, '' as key, 0 as chars from convs
  union all
  select c, d, string_agg(sha256(strlen(role) || ':' || role || text), ',') over (partition by c order by d),
    length(text)
  from rebuilt
),
lasts as (select c, max(d) as d from places group by c),
nodes as (
  select key, d, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars from places group by key, d
),
pairs as (
  select distinct a.key as top, b.key from places a join places b on a.c = b.c and a.d <= b.d
),
links as (
  select distinct a.key as top, b.key from places a join places b on a.c = b.c and a.d + 1 = b.d
),
kids as (select top, count(*) as n from links group by top),
sums as (
  select p.top, sum((n.n_convs - 1) * n.chars) as saved, count(*) filter (where k.n is null) as leaves
  from pairs p join nodes n on n.key = p.key left join kids k on k.top = p.key group by p.top
),
ended as (
  select p.key, string_agg(p.c::varchar, ',' order by p.c) as ids
  from places p join lasts l on l.c = p.c and l.d = p.d group by p.key
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs,
  coalesce(k.n, 0) as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens,
  sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join sums s on s.top = n.key left join kids k on k.top = n.key
  left join links l on l.key = n.key left join nodes u on u.key = l.top left join ended e on e.key = n.key
"""
