"""URL filters from association rules, with built-in functions only.

Spark's FP-growth mines the token combinations of labelled urls; an inverted index counts the
other urls that have them.  Rules that are sure and frequent enough, and surer than the same
rule with a token fewer, make up the filter.  An inverted index from each rule's rarest token
finds the rules of a url.  A short list of given rules goes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
#: Parts of host names that sell, track or deceive; pages of such hosts are labelled block.
SEED_WORDS = (
    "casino", "pills", "viagra", "adult", "porn", "bets", "betting", "poker", "spam", "ads",
    "adserver", "track", "tracker", "malware", "phish", "warez", "loan", "replica",
)
#: Parts of all looked-up tokens that one group may hold.
PARTS = 1024


def with_parts(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """``pages`` with host, path and query; all empty for null and where no :// is."""
    url = F.coalesce(pages[url_column].cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    split = pages.withColumn("_url", url).withColumn("_rest", rest)
    split = split.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0)).withColumn(
        "_tail", F.expr("substring(_rest, length(_host) + 1)")
    )
    return (
        split.withColumn("host", F.translate("_host", UPPER, LOWER))
        .withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0))
        .withColumn("query", F.regexp_extract("_tail", r"^[^?#]*\?([^#]*)", 1))
        .drop("_url", "_rest", "_host", "_tail")
    )


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: labels of the host from its end, segments of the path, names in the query.

    Digits are all 0.
    """

    def marked(mark: str, parts: Column) -> Column:
        return F.transform(
            F.filter(parts, lambda x: x != ""),
            lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")),
        )

    return F.array_distinct(
        F.concat(
            marked("h:", F.reverse(F.split(host, r"\."))),
            marked("p:", F.split(path, "/")),
            marked("q:", F.transform(F.split(query, "[&;]"), lambda x: F.element_at(F.split(x, "="), 1))),
        )
    )


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (length, rule, verdict) of the longest (verdict, host/path) rule that fits, or null."""
    fitting = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        fitting.append(
            F.when(
                fits,
                F.struct(
                    F.lit(len(rule)).alias("length"),
                    F.lit(rule).alias("rule"),
                    F.lit(verdict).alias("verdict"),
                ),
            )
        )
    nothing = F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    return F.greatest(nothing, *fitting, nothing)


def labelled(
    pages: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str] = SEED_WORDS
) -> DataFrame:
    """(tokens, label) of every page: by a given rule, else block for a seed word in the host.

    All other pages count as allowed, so that a token of blocked and of unknown urls
    blocks none.
    """
    parts = with_parts(pages)
    seeded = F.arrays_overlap(
        F.split("host", r"[.\-_]"), F.array(*(F.lit(word) for word in seeds))
    )
    label = F.coalesce(
        given_rule(F.col("host"), F.col("path"), rules)["verdict"],
        F.when(seeded, BLOCK).otherwise(ALLOW),
    )
    return parts.select(
        tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), label.alias("label")
    )


EMPTY = (
    "rule_id string, items array<string>, verdict string, confidence double, support double,"
    " token string"
)


def _looked_up(urls: DataFrame, index: DataFrame, how: str) -> DataFrame:
    """``urls``, one row for each ``token`` of a ``row``, joined with an index by token.

    A token with more than one part in ``PARTS`` of all rows is dealt into groups in proportion.
    There are fewer than ``PARTS`` of these, at any size of input, so their list may be broadcast.
    """
    top = urls.filter(F.col("token").isNotNull()).agg(
        F.expr(f"approx_top_k(token, {PARTS}, {16 * PARTS})").alias("top"),
        F.count(F.lit(1)).alias("total"),
    )
    share = F.col("top.count") * PARTS / F.col("total")
    hot = F.broadcast(
        pin(
            top.select(F.explode("top").alias("top"), "total")
            .filter(share > 1)
            .select(F.col("top.item").alias("token"), F.ceil(share).cast("int").alias("groups"))
        )
    )
    groups = F.coalesce("groups", F.lit(1))
    dealt = urls.join(hot, "token", "left").withColumn("salt", F.pmod("row", groups).cast("int"))
    copied = index.join(hot, "token", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), groups - 1))
    )
    return dealt.drop("groups").join(copied.drop("groups"), ["token", "salt"], how).drop("salt")


def _singles(baskets: DataFrame, min_count: int) -> DataFrame:
    """(token, n, hits, a, b) of tokens with ``min_count`` hits; a and b name the set of its urls."""
    placed = baskets.select("row", "hit", F.explode("tokens").alias("token"))
    return pin(
        placed.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("hit").cast("long")).alias("hits"),
            F.bit_xor(F.xxhash64("row")).alias("a"),
            F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"),
        )
        .filter(F.col("hits") >= min_count)
    )


def _combinations(
    baskets: DataFrame, single: DataFrame, min_count: int, max_items: int | None
) -> DataFrame | None:
    """(items, n, hits) of the combinations that FP-growth finds in ``min_count`` hits; None if none.

    A token that is certain by itself, or that occurs in just the urls of a lesser one, makes no
    combination surer than without it and is left out before.
    """
    tokens_left = pin(
        single.filter("hits < n").groupBy("n", "hits", "a", "b").agg(F.min("token").alias("token"))
    )
    placed = _looked_up(
        baskets.select("row", "hit", F.explode("tokens").alias("token")),
        tokens_left.select("token"),
        "inner",
    )
    rows = pin(
        placed.groupBy("row", "hit")
        .agg(F.collect_list("token").alias("left"))
        .filter(F.size("left") > 1)
    )
    hits = rows.filter("hit")
    total = hits.count()
    if total < min_count:
        return None
    # half a url less, so that rounding never asks for one more
    miner = FPGrowth(itemsCol="left", minSupport=(min_count - 0.5) / total)
    wanted = F.size("items") > 1
    if max_items is not None:
        wanted &= F.size("items") <= max_items
    sets = pin(
        miner.fit(hits).freqItemsets.filter(wanted).select(
            F.sort_array("items").alias("items"), F.col("freq").alias("hits")
        )
    )
    index = (
        sets.select("items", F.explode("items").alias("token"))
        .join(tokens_left.select("token", (F.col("n") - F.col("hits")).alias("misses")), "token")
        .groupBy("items")
        .agg(F.min_by("token", F.struct("misses", "token")).alias("token"))
    )
    others = rows.filter("not hit").select("row", "left", F.explode("left").alias("token"))
    missed = (
        _looked_up(others, index, "inner")
        .filter(F.size(F.array_except("items", "left")) == 0)
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("misses"))
    )
    return sets.join(missed, "items", "left").select(
        "items", (F.col("hits") + F.coalesce("misses", F.lit(0))).alias("n"), "hits"
    )


def mine(
    labels: DataFrame,
    min_count: int = 5,
    min_confidence: float = 0.8,
    max_items: int | None = None,
    verdicts: Sequence[str] = (BLOCK,),
) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support, token) of (tokens, label) rows.

    Spark's FP-growth mines the urls of each of ``verdicts``; the verdict that urls get by default
    needs none.  Rules hold for ``min_count`` urls at least, however many urls there are, and have
    tokens from anywhere in a url, as many as there are unless ``max_items`` is given.  Of tokens
    that occur in the same urls each may be a rule, the least alone is combined with others.
    ``token`` is the item of a rule that is rarest among the labelled urls.  The table is
    pinned.  Combinations grow with the power of the tokens that blocked and other urls share.
    """
    baskets = pin(
        labels.select(
            F.monotonically_increasing_id().alias("row"),
            F.array_distinct("tokens").alias("tokens"),
            "label",
        )
    )
    totals = {r["label"]: r["count"] for r in baskets.groupBy("label").count().collect()}
    n = sum(totals.values())
    verdicts = [v for v in verdicts if v in totals]
    if not verdicts:
        return labels.sparkSession.createDataFrame([], EMPTY)
    tables, singles = [], []
    for verdict in verdicts:
        marked = baskets.select("row", "tokens", (F.col("label") == verdict).alias("hit"))
        single = _singles(marked, min_count)
        singles.append(single.select("token", F.lit(verdict).alias("verdict"), "n"))
        combined = _combinations(marked, single, min_count, max_items)
        alone = single.select(F.array("token").alias("items"), "n", "hits")
        sure = F.col("hits") / F.col("n")
        tables += [
            found.filter((sure >= min_confidence) & (sure > totals[verdict] / n)).select(
                "items",
                F.lit(verdict).alias("verdict"),
                sure.alias("confidence"),
                (F.col("hits") / n).alias("support"),
            )
            for found in (alone, combined)
            if found is not None
        ]
    rules = pin(reduce(DataFrame.unionByName, tables))
    single = reduce(DataFrame.unionByName, singles)
    shorter = rules.select(
        F.col("items").alias("part"), "verdict", F.col("confidence").alias("already")
    )
    redundant = (
        rules.select(
            "items",
            "verdict",
            "confidence",
            F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"),
        )
        .join(shorter, ["part", "verdict"])
        .filter("already >= confidence")
        .select("items", "verdict")
        .distinct()
    )
    kept = rules.join(redundant, ["items", "verdict"], "left_anti").withColumn(
        "rule_id", F.array_join("items", " ")
    )
    rarest = (
        kept.select("rule_id", "verdict", F.explode("items").alias("token"))
        .join(single, ["token", "verdict"])
        .groupBy("rule_id", "verdict")
        .agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    )
    return pin(
        kept.join(rarest, ["rule_id", "verdict"]).select(
            "rule_id", "items", "verdict", "confidence", "support", "token"
        )
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    mined: DataFrame,
    default: str = ALLOW,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, mined_rule, confidence) of every row of ``pages``.

    The longest fitting given rule decides; else the surest mined rule whose items are
    all in the url (of equals the more frequent, then the longer); else ``default``.
    A url that is null or has no :// has an empty host and path and no tokens.  Repeated rows
    and null ids are judged like any other; other columns are not read.
    """
    row = F.monotonically_increasing_id()  # the row's place in its file, the same when read again
    parts = with_parts(pages.select(pages[id_column].alias("_id"), pages[url_column].alias("url")))
    placed = parts.select(
        "_id",
        "host",
        "path",
        given_rule(F.col("host"), F.col("path"), rules).alias("given"),
        tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"),
        row.alias("row"),
    )
    index = mined.select(
        "token", "items", F.struct(
            "confidence", "support", F.size("items").alias("size"), "verdict", "rule_id"
        ).alias("found")
    )
    looked_up = _looked_up(placed.withColumn("token", F.explode_outer("tokens")), index, "left")
    fits = F.size(F.array_except("items", "tokens")) == 0
    best = looked_up.groupBy("row", "_id", "host", "path", "given").agg(
        F.max(F.when(fits, F.col("found"))).alias("found")
    )
    return best.select(
        F.col("_id").alias(id_column),
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "found.verdict", F.lit(default)).alias("verdict"),
        F.col("found.rule_id").alias("mined_rule"),
        F.col("found.confidence").alias("confidence"),
    )
