"""Line-first cleaning with built-in functions only.

Every line is judged by rules of punctuation, navigation and boilerplate;
failing lines go, and a document that loses too much of its text goes with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import text_or_empty

BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
#: A line of prose that is left in a page's frame.
BOILERPLATE = (
    r"(?i)(all rights reserved|licen[sc]ed under|\bcopyright\b|terms of (use|service)|"
    r"privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|"
    r"lorem ipsum|click here|share (this|on) |subscribe to our|sign up for|log ?in to)"
)
#: Menus and breadcrumbs: three separators with words between them.
NAVIGATION = r"([|»›•·][^|»›•·]+){3}"
#: No lower-case letter in a line with capitals, or exclamations after one another.
#: Nothing is tried twice, so this takes time in proportion to a line.
SHOUTED = r"^[^\p{Ll}\p{Lu}]*+\p{Lu}[^\p{Ll}\p{Lu}]*+\p{Lu}[^\p{Ll}]*+$"
#: A fragment: up to three words without a sign that ends a sentence.
FRAGMENT = r"^[^\s]+(\s+[^\s]+){0,2}$"
SENTENCE_END = r"[.!?:;…。！？\"'”’»)\]]\s*$"


def line_fails(line: Column, max_symbols: float = 0.05) -> Column:
    """Whether a line goes: symbols, navigation, boilerplate, shouting or fragments."""
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOL, ""))
    return (
        (symbols > F.length(line) * max_symbols)
        | line.rlike(NAVIGATION)
        | line.rlike(BOILERPLATE)
        | line.rlike(SHOUTED)
        | (line.rlike(FRAGMENT) & ~line.rlike(SENTENCE_END))
    )


def repeated_words(words: str) -> list[tuple[str, Column]]:
    """Steps, each a new column, to ``n_repeat_words`` of an array column.

    Windows of three words are compared by 64-bit hashes within a text.  Only texts
    with equal windows sort them to find which words these cover.
    """
    w, tri, placed = F.col(words), F.col("_windows"), F.col("_placed")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    repeated = F.size(F.array_distinct(tri)) < F.size(tri)
    sort = F.when(
        repeated,
        F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    alike = F.filter(
        placed,
        lambda x, i: (F.get(placed, i - 1)["h"] == x["h"]).eqNullSafe(True)
        | (F.get(placed, i + 1)["h"] == x["h"]).eqNullSafe(True),
    )
    covered = F.size(
        F.array_distinct(
            F.flatten(F.transform(alike, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        )
    )
    count = F.when(placed.isNull(), 0).otherwise(covered).cast("long")
    return [("_windows", windows), ("_placed", sort), ("n_repeat_words", count)]


def quality_rules(
    docs: DataFrame,
    min_words: int = 50,
    max_repeated: float = 0.5,
    max_lost: float = 0.5,
    max_symbols: float = 0.05,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics, verdict and cleaned text of every row of ``docs``.

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost, clean_text) and the columns of ``carry``.  Words are runs without
    blanks (space, tab, line ends).  ``base_failed``: fewer than ``min_words`` words, or more
    than ``max_repeated`` of them in repeated windows of three.  ``lost`` is the share
    of word characters in lines that fail; ``kept`` asks for no base failure and
    at most ``max_lost``.

    Null and empty texts have no words and fail.  A blank line is neither
    judged nor lost.  Rows are independent: repeated rows get the same result, nothing is shuffled,
    columns not named are not read.
    """
    text = text_or_empty(docs, text_column)
    df = docs.select(
        docs[id_column].alias("_id"),
        *(docs[c].alias(f"_carry_{c}") for c in carry),
        text.alias("_text"),
        F.btrim(text, F.lit(BLANKS)).alias("_trimmed"),
    )
    t = F.col("_text")
    df = df.select(
        "*",
        F.when(F.col("_trimmed") != "", F.split("_trimmed", BLANK + "+"))
        .otherwise(F.array().cast("array<string>"))
        .alias("_words"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.filter("_lines", lambda line: ~line_fails(line, max_symbols)).alias("_good"),
    )
    for name, column in repeated_words("_words"):
        df = df.withColumn(name, column)
    good = F.array_join("_good", "\n")
    good_chars = F.length(F.regexp_replace(good, BLANK + "+", ""))
    df = df.select(
        "*",
        good.alias("clean_text"),
        F.when(F.col("word_chars") > 0, 1 - good_chars / F.col("word_chars"))
        .otherwise(0.0)
        .alias("lost"),
        (
            (F.col("n_words") < min_words)
            | (F.col("n_repeat_words") > F.col("n_words") * max_repeated)
        ).alias("base_failed"),
    )
    return df.select(
        F.col("_id").alias(id_column),
        *(F.col(f"_carry_{c}").alias(c) for c in carry if c != id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("lost") <= max_lost)).alias("kept"),
        "lost",
        "clean_text",
    )


def clean(docs: DataFrame, text_column: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows that the rules reject and the lines that fail, in the same columns."""
    kept = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(kept))))
    text = f"c{kept.index(text_column)}"
    judged = quality_rules(
        numbered, id_column=text, text_column=text, carry=tuple(numbered.columns), **limits
    )
    # a filter does not move below a column like this one, so the verdict is worked out once
    kept_rows = judged.withColumn("row", F.monotonically_increasing_id()).filter("kept and row >= 0")
    return kept_rows.select(
        *(F.col("clean_text" if c == text else c).alias(name) for c, name in zip(numbered.columns, kept, strict=True))
    )


#: DuckDB twin of the query over ``documents``.
ORACLE_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text from documents
), w as (
  select doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from t
), g as (
  select doc_id, text, words, lines,
    [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]
      for i in range(1, len(words) - 1)] as windows,
    list_filter(lines, lambda x: not (
      length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > length(x) * 0.05
      or regexp_matches(x, '([|»›•·][^|»›•·]+){3}')
      or regexp_matches(x, '(?i)(all rights reserved|licen[sc]ed under|\bcopyright\b|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|lorem ipsum|click here|share (this|on) |subscribe to our|sign up for|log ?in to)')
      or regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$')
      or (regexp_matches(x, '^[^\s]+(\s+[^\s]+){0,2}$')
        and not regexp_matches(x, '[.!?:;…。！？"''”’»)\]]\s*$'))
    )) as good
  from w
), n as (
  select doc_id, i, window_text, count(*) over (partition by doc_id, window_text) as n
  from (select doc_id, unnest(windows) as window_text, unnest(range(len(windows))) as i from g)
), covered as (
  select doc_id, count(distinct i + d) as n_repeat_words
  from n, (values (0), (1), (2)) v(d) where n > 1 group by doc_id
), s as (
  select g.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]+', '', 'g')) as good_chars
  from g left join covered using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 1 - good_chars / word_chars <= 0.5 as kept
from b
"""
