from pyspark.sql import functions as F

from typeloom.functions.hashing import code32, code32_of, hash01, packed, unpacked
from typeloom.functions.labels import clean_set, label_key, pg_type, xsd_type
from typeloom.functions.sizing import FREED, keep, pin, shuffles_freed
from typeloom.functions.values import flag_columns, is_date

# value -> integer, double, date (lenient), boolean, ip
EXPECTED = {
    "5": (1, 1, 1, 0, 0),
    " 5\t": (1, 1, 1, 0, 0),
    "+5": (1, 1, 0, 0, 0),
    "-5": (1, 1, 1, 0, 0),
    "1": (1, 1, 1, 1, 0),
    "1e3": (0, 1, 1, 0, 0),
    "1d": (0, 1, 1, 0, 0),
    ".5": (0, 1, 0, 0, 0),
    "5.": (0, 1, 1, 0, 0),
    "0x1p3": (0, 1, 1, 0, 0),
    "NaN": (0, 1, 0, 0, 0),
    "-Infinity": (0, 1, 0, 0, 0),
    "2147483647": (1, 1, 1, 0, 0),
    "2147483648": (0, 1, 1, 0, 0),
    "2010-01-03": (0, 0, 1, 0, 0),
    "2010-01-03T10:00:00": (0, 0, 1, 0, 0),
    "12abc": (0, 0, 1, 0, 0),
    "yes": (0, 0, 0, 1, 0),
    "TRUE ": (0, 0, 0, 1, 0),
    "falsely": (0, 0, 0, 0, 0),
    "192.168.0.1": (0, 0, 1, 0, 1),
    "192.168.0.256": (0, 0, 1, 0, 0),
    "1.2.3": (0, 0, 1, 0, 0),
    "abc": (0, 0, 0, 0, 0),
    "": (0, 0, 0, 0, 0),
    "é" * 3000: (0, 0, 0, 0, 0),
}


def test_value_tests(spark):
    df = spark.createDataFrame([(v,) for v in EXPECTED], "value string")
    flags = [f.cast("int").alias(n) for n, f in flag_columns(F.col("value")).items()]
    got = {r[0]: tuple(r[1:]) for r in df.select("value", *flags).collect()}
    assert got == EXPECTED


def test_null_values_pass_no_test(spark):
    df = spark.createDataFrame([(None,)], "value string")
    flags = list(flag_columns(F.col("value")).values())
    assert all(v is None for v in df.select(*flags).first())


def test_strict_dates(spark):
    fit = ["2010-01-03", "03/01/2010", "01-03-2010", "2010/01/03", "2010", "2010/01", "01/2010"]
    other = ["2010-01-03T10:00:00", "12abc", "5", "192.168.0.1"]
    df = spark.createDataFrame([(v,) for v in fit + other], "value string")
    got = {r[0] for r in df.filter(is_date(F.col("value"), strict=True)).collect()}
    assert got == set(fit)


def test_labels(spark):
    df = spark.createDataFrame(
        [(["b", "a", "b", ""],), ([],), (None,)], "labels array<string>"
    )
    rows = df.select(clean_set(F.col("labels")), label_key(F.col("labels"))).collect()
    assert [r[0] for r in rows] == [["a", "b"], [], []]
    assert rows[1][1] == "" and rows[2][1] == ""


def test_type_names(spark):
    df = spark.createDataFrame(
        [("Integer",), (" double ",), ("Date",), ("Unknown (empty)",), ("int32",)], "t string"
    )
    assert [r[0] for r in df.select(pg_type(F.col("t"))).collect()] == [
        "INTEGER",
        "DOUBLE",
        "DATE",
        "STRING",
        "INT32",
    ]
    assert [r[0] for r in df.select(xsd_type(F.col("t"))).collect()] == [
        "xs:integer",
        "xs:double",
        "xs:date",
        "xs:string",
        "xs:integer",
    ]


def test_hash_codes_agree_with_the_driver(spark):
    df = spark.createDataFrame([("abc",), ("é|1",), ("",)], "x string")
    rows = df.select("x", code32(F.col("x")).alias("c"), hash01(F.col("x")).alias("h")).collect()
    for r in rows:
        assert r["c"] == code32_of(r["x"])
        assert 0 <= r["h"] < 1


def test_packed_text_comes_back(spark):
    md5 = "c4ca4238a0b923820dcc509a6f75849b"
    texts = ["", "a", "0", "00", "ab", "AB", "aB", "abc", "\x00", "\x01\x01", "é", "O:12", " 12", md5, md5.upper(), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed(F.col("t")))
    got = rows.select("t", unpacked(F.col("p")).alias("back"), F.length("p").alias("size")).collect()
    assert all(r["back"] == r["t"] for r in got)
    assert {r["t"]: r["size"] for r in got}[md5] == 17
    odd = spark.range(1).select(F.unhex(F.lit("ff41")).cast("string").alias("t"))  # no UTF-8
    same = F.hex("t") == F.hex(unpacked(packed(F.col("t"))))
    assert odd.select(same).first()[0]


def _held(spark):
    """Shuffle files on disk."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_what_is_pinned_or_kept_holds_no_shuffle(spark):
    before = _held(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for make in (pin, keep):
        held = make(counts)
        assert held.columns == counts.columns and sorted(held.collect()) == sorted(counts.collect())
        counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count().collect()
    other = _held(spark)
    pin(counts), keep(counts)
    assert not _held(spark) - other
    assert other - before  # those of plain runs stay


def test_the_setting_of_freed_shuffles_is_put_back(spark):
    default = spark.conf.get(FREED)
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            assert spark.conf.get(FREED) == "true"
        assert spark.conf.get(FREED) == "true"
    assert spark.conf.get(FREED) == default
