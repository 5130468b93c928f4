"""Documents with everything that data can have wrong."""

LONG = "alpha beta gamma, delta. " * 4000
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (4, "one two"),
    (5, "'ll it's  e\u0301 caf\u00e9\u00a0x <|endoftext|> \U0001f600!!\r\n don't"),
    (None, "a text without an id"),
    (6, LONG),
    (6, "the same id, another text"),
]
#: Columns whose names the operators use for themselves.
EXTRA = "id, c0, text_, kept, score, ids, part, spans, base, n_words, key, keys, bag, row, path"


def odd_docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *(f"'x' as {c.strip()}" for c in EXTRA.split(",")))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
