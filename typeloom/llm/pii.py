"""Personal data by weak supervision, with built-in functions only.

Regex, gazetteer and context labelers vote on candidate spans.  Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is
and how likely each pattern is personal data; a logistic span classifier is then
fitted to these soft labels and scores every candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin, work_folder
from typeloom.llm.common import text_or_empty

# Possessive and anchored forms of the stated patterns: they find the same matches
# without trying a long run of digits or letters from each of its characters.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of 14 to 19 digits; shorter and longer runs would be dropped.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Noncharacters, which are neither letters, digits nor white space.
MARK, UNMARKED = "\uffff", "\ufffe"
#: Characters on either side that the context labelers see.
CONTEXT = 48
FIELDS = (
    "ssn|passport|iban|account|acct|phone|tel|mobile|fax|e-?mail|contact|card|visa|born|dob|"
    "password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|key|login|user(?:name)?"
)
#: Candidates beyond the stated patterns: words of eight and more characters with a digit,
#: addresses whose signs are spelt out, values behind a field word, groups of capitalised words
#: with a number of a house before or behind them.
WORDY = "A-Za-z0-9_+/-"
VALUE = r"[^\s\"',;<>()]*[^\s\"',;<>().!?:]"
GROUP = r"\p{Lu}[\p{L}'\u2019-]*+(?: \p{Lu}[\p{L}'\u2019-]*+){1,3}+"
CANDIDATE = (
    rf"(?<![{WORDY}])(?=[A-Za-z_+/-]*+[0-9])[{WORDY}]{{8,}}+(?![{WORDY}])"
    r"|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}+"
    r"(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,64}+){1,4}"
    # from the cheapest test to the dearest
    r"|(?<=[\s:=#\"'])(?=\S)(?<=[:=#\"']|[:=#]\s|[:=#]\s\s|[oOsSrR.]\s|[oOsSrR.]\s\s)"
    rf"(?<=\b(?i:{FIELDS})\s{{0,2}}(?:(?i:no\.?|number|is)\s{{0,2}}[:=#]?|[:=#])\s{{0,2}}[\"']?)"
    rf"(?!(?i:no|number|is)\b){VALUE}"
    rf"|(?<![\p{{L}}\p{{N}}_])(?:[0-9]{{1,5}}[a-z]? )?+{GROUP}(?: [0-9]{{1,5}}+[a-z]?(?![\p{{L}}\p{{N}}_]))?+"
)
#: Gazetteers, lower-cased: given names, and what is capitalised but no person.
NAMES = tuple(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark "
    "steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas "
    "eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander patrick jack mary patricia "
    "jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily "
    "donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna alice "
    "maria ana carlos jose juan luis miguel pedro sofia lucia carmen pablo diego javier hans peter klaus jürgen wolfgang "
    "stefan andreas ursula monika petra sabine claudia heike jean pierre michel jacques françois nathalie isabelle sophie "
    "camille marie claire antoine mohammed ahmed fatima ali omar aisha wei ming li chen yuki hiroshi priya raj anil "
    "ivan olga natasha dmitri".split()
)
PLACES = tuple(
    "london paris berlin madrid rome vienna zurich geneva munich hamburg cologne frankfurt lyon marseille barcelona "
    "seville lisbon dublin oslo stockholm copenhagen helsinki warsaw prague budapest athens moscow tokyo beijing shanghai "
    "delhi mumbai sydney toronto montreal boston chicago houston dallas seattle denver miami atlanta england france germany "
    "spain italy austria switzerland europe africa asia america canada mexico china japan india russia australia north south "
    "east west new york san francisco los angeles united states kingdom january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday the".split()
)
STREET = (
    r"(?iu)(?:^[0-9]{1,5}[a-z]? .*\b(?:street|st|road|rd|avenue|ave|lane|drive|court|square|boulevard|rue|calle|platz|way)$"
    r"|(?:\b(?:street|road|avenue|lane|rue|calle|platz|weg)|stra(?:ß|ss)e|gasse)\b.* [0-9]{1,5}[a-z]?$)"
)
#: Words that stand behind a field word without being its value.
FILLER = (
    r"(?i)^(?:an?|the|that|this|these|it|its|to|not|in|on|of|for|by|at|and|or|be|as|what|how|why|when|where|you|your|my|our|"
    r"their|his|her|very|also|only|now|always|never|still|required|needed|valid|invalid|wrong|true|false|null|none)$"
)
ISSUED = (
    r"^(?:AKIA[A-Z0-9]{12,}|sk-[A-Za-z0-9]{16,}|gh[ps]_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{8,}"
    r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
)
SPELT = r"[(\[]at[)\]]"
MIXED = (
    r"^(?:(?=[0-9]*[a-f])[0-9a-f]{16,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Za-z0-9_+/-]{16,})$"
)
#: A word with a number behind it, such as a name of a version.
NAMED = r"^[A-Za-z_+/-]*[a-z][A-Za-z_+/-]*[0-9]{1,2}$"
PLAIN = r"^(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{8,12}|[A-Za-z]+-[0-9]{1,4}|[A-Za-z-]+[0-9]{1,2})$"
HARMLESS = r"(?i)(?:\bversion|\bv|\bchapter|\bsection|\bpage|\bfigure|\btable|\bstep|\bpart|\bvol(?:ume)?|\bno|©|\bcopyright|\blicen[sc]ed? [^\n]{0,40})[.,]?\s*$"
LABELERS = ("issued", "gazetteer", "field", "near", "mixed", "plain", "harmless")
BUCKETS = ("length_bucket", "digit_bucket")
SPAN = "struct<start: int, kind: int, end: int>"


@dataclass(frozen=True)
class VoteModel:
    """What EM and the classifier found; its size depends on the labelers alone."""

    prior: float
    #: labeler -> vote -> (share among personal data, share among the rest)
    reliability: dict[str, dict[int, tuple[float, float]]]
    weights: dict[str, float]
    intercept: float


def located(text: Column, pattern: str, when: Column) -> Column:
    """Array of (text, start, end, before, after) of a pattern's matches, in code points.

    The pattern, which matches no empty text, is searched for once: its matches are set between marks,
    and the text is cut at these into gaps and matches in turn, so places are running sums of lengths.
    A mark that the text has itself counts as another noncharacter, of the same length, to the pattern.
    """
    kind = "array<struct<text: string, start: int, end: int, before: string, after: string>>"
    plain = F.when(text.contains(MARK), F.translate(text, MARK, UNMARKED)).otherwise(text)
    pieces = F.split(F.regexp_replace(plain, pattern, f"{MARK}$0{MARK}"), MARK)

    def spans(p: Column) -> Column:
        turns = F.transform(
            p,
            lambda x, i: F.struct(
                x.alias("text"),
                (i % 2 == 1).alias("match"),
                F.get(p, i - 1).alias("before"),
                F.get(p, i + 1).alias("after"),
            ),
        )
        return F.aggregate(
            turns,
            F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["text"])).alias("at"),
                F.when(
                    x["match"],
                    F.concat(
                        acc["spans"],
                        F.array(
                            F.struct(
                                x["text"].alias("text"),
                                acc["at"].alias("start"),
                                (acc["at"] + F.length(x["text"])).alias("end"),
                                F.right(x["before"], F.lit(CONTEXT)).alias("before"),
                                F.substring(x["after"], 1, CONTEXT).alias("after"),
                            )
                        ),
                    ),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    # a lambda's variable is computed once, however often it is used
    found = F.get(F.transform(F.array(pieces), spans), F.lit(0))
    return F.when(when, found).otherwise(F.array().cast(kind))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")
        ),
    )


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the four base kinds, by start and kind."""

    def digits(x: Column) -> Column:
        return F.regexp_replace(x["text"], "[^0-9]", "")

    digit = text.rlike("[0-9]")
    rules = (
        (EMAIL, text.contains("@"), lambda x: F.lit(True)),
        (IP, digit, lambda x: x["text"].rlike(OCTETS)),
        (CARD, digit, lambda x: F.call_function("luhn_check", digits(x))),
        (PHONE, text.contains("+"), lambda x: F.length(digits(x)).between(10, 15)),
    )
    found = [
        _of_kind(F.filter(located(text, pattern, when), holds), kind)
        for kind, (pattern, when, holds) in enumerate(rules)
    ]
    return F.sort_array(F.concat(*found))


def votes(x: Column) -> dict[str, Column]:
    """1 for personal data, -1 against, 0 for no opinion."""

    def vote(yes: Column, no: Column | None = None) -> Column:
        out = F.when(yes, 1)
        return (out if no is None else out.when(no, -1)).otherwise(0)

    def listed(names: tuple[str, ...]) -> Column:
        return F.array(*map(F.lit, names))

    span, before, after = x["text"], x["before"], x["after"]
    words = F.split(F.lower(span), r"[^\p{L}]+")
    group = span.rlike(rf"^{GROUP}")
    return {
        "issued": vote(span.rlike(ISSUED) | span.rlike(SPELT)),
        "gazetteer": vote(
            (group & F.arrays_overlap(words, listed(NAMES))) | span.rlike(STREET),
            group & (F.size(F.array_except(words, listed((*PLACES, "")))) == 0),
        ),
        "field": vote(before.rlike(rf"(?i)\b(?:{FIELDS})\s*(?:no\.?|number|is)?\s*[:=#]?\s*[\"']?$")),
        "near": vote(
            before.rlike(rf"(?i)\b(?:{FIELDS})\b") | after.rlike(rf"(?i)\b(?:{FIELDS})\b")
        ),
        "mixed": vote(span.rlike(MIXED), span.rlike(NAMED)),
        # a bare number that is neither issued nor named, such as a card's with a false check digit
        "plain": vote(
            F.lit(False), span.rlike(PLAIN) | span.rlike("^[0-9]+$") | span.rlike(FILLER)
        ),
        "harmless": vote(F.lit(False), before.rlike(HARMLESS)),
    }


def candidates(text: Column, base: Column) -> Column:
    """Array of candidate spans with votes; spans that overlap a base span are none."""
    free = F.filter(
        located(text, CANDIDATE, F.length(text) > 0),
        lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    digits = lambda x: F.length(F.regexp_replace(x["text"], "[^0-9]", ""))
    return F.transform(
        free,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            *(v.cast("int").alias(k) for k, v in votes(x).items()),
            F.when(F.length(x["text"]) < 12, 0)
            .when(F.length(x["text"]) < 16, 1)
            .when(F.length(x["text"]) < 24, 2)
            .otherwise(3)
            .alias("length_bucket"),
            F.when(digits(x) * 4 < F.length(x["text"]), 0)
            .when(digits(x) * 4 < F.length(x["text"]) * 3, 1)
            .otherwise(2)
            .alias("digit_bucket"),
        ),
    )


#: What labelers are held to do before votes are counted: (among personal data, among the rest).
EXPECTED = {1: (0.45, 0.05), 0: (0.5, 0.5), -1: (0.05, 0.45)}
#: Candidates that this expectation counts for.
EXPECTED_WEIGHT = 10.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> tuple[float, dict]:
    """EM over counted vote patterns: prior and (P(vote | yes), P(vote | no)) of each labeler."""
    belief = [1 / (1 + math.exp(-2 * sum(p))) for p, _ in patterns]
    prior, rates = 0.5, {}
    for _ in range(rounds):
        rows = [(p, n * q, n * (1 - q)) for (p, n), q in zip(patterns, belief, strict=True)]
        yes, no = sum(r[1] for r in rows), sum(r[2] for r in rows)
        prior = (yes + 1) / (yes + no + 2)
        rates = {
            name: {
                v: tuple(
                    (sum(r[side] for r in rows if r[0][i] == v) + EXPECTED_WEIGHT * EXPECTED[v][side - 1])
                    / (total + EXPECTED_WEIGHT)
                    for side, total in ((1, yes), (2, no))
                )
                for v in EXPECTED
            }
            for i, name in enumerate(LABELERS)
        }
        belief = [1 / (1 + math.exp(-_log_odds(prior, rates, p))) for p, _ in patterns]
    return prior, rates


def _log_odds(prior: float, rates: dict, pattern: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(
        math.log(rates[name][v][0] / rates[name][v][1])
        for name, v in zip(LABELERS, pattern, strict=True)
    )
    return max(-30.0, min(30.0, odds))


def _features() -> dict[str, Column]:
    """Of a candidate: its votes for and against, and its buckets."""
    out = {}
    for name in LABELERS:
        out[f"{name}_for"] = (F.col(name) == 1).cast("double")
        out[f"{name}_against"] = (F.col(name) == -1).cast("double")
    for name, values in (("length_bucket", (1, 2, 3)), ("digit_bucket", (1, 2))):
        for v in values:
            out[f"{name}_{v}"] = (F.col(name) == v).cast("double")
    return out


def fit(found: DataFrame) -> VoteModel | None:
    """Model from the candidates of all documents; None where there are none.

    Only counts of vote patterns reach the driver, at most 3 to the power of seven, in few buckets.
    """
    key = [*LABELERS, *BUCKETS]
    counts = pin(
        found.select(F.explode("candidates").alias("c"))
        .select("c.*")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_votes = counts.groupBy(*LABELERS).agg(F.sum("n").alias("n")).collect()
    if not by_votes:
        return None
    patterns = sorted((tuple(r[name] for name in LABELERS), r["n"]) for r in by_votes)
    prior, rates = estimate(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for name in LABELERS:
        ratio = {v: math.log(a / b) for v, (a, b) in rates[name].items()}
        odds += F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    belief = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    features = _features()
    rows = counts.select(
        *(c.alias(k) for k, c in features.items()),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), (belief * F.col("n")).alias("weight")),
                F.struct(F.lit(0.0).alias("label"), ((1 - belief) * F.col("n")).alias("weight")),
            )
        ).alias("soft"),
    ).select(*features, "soft.label", "soft.weight")
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    model = LogisticRegression(
        weightCol="weight", regParam=1e-3, maxIter=50, standardization=False
    ).fit(assembled)
    return VoteModel(
        prior, rates, dict(zip(features, map(float, model.coefficients), strict=True)), float(model.intercept)
    )


def _score(x: Column, model: VoteModel) -> Column:
    terms = []
    for name in LABELERS:
        terms.append(
            F.when(x[name] == 1, model.weights[f"{name}_for"])
            .when(x[name] == -1, model.weights[f"{name}_against"])
            .otherwise(0.0)
        )
    for name, values in (("length_bucket", (1, 2, 3)), ("digit_bucket", (1, 2))):
        for v in values:
            terms.append(F.when(x[name] == v, model.weights[f"{name}_{v}"]).otherwise(0.0))
    logit = reduce(lambda a, b: a + b, terms, F.lit(model.intercept))
    return 1 / (1 + F.exp(-logit))


def _listed(spans: Column, names: tuple[str, ...]) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


KINDS = (*BASE_KINDS, "other")


def found_spans(
    docs: DataFrame, text_column: str, threshold: float = 0.5, keep_text: bool = False
) -> DataFrame:
    """``docs`` as columns c0, c1, ... and arrays ``base`` and ``all`` of spans.

    The arrays hold (start, kind, end) by start and kind; ``all`` adds the candidates that
    the classifier gives at least ``threshold``.  The texts are searched once: spans are
    pinned, and with ``keep_text`` all columns are written to the work folder with them.
    """
    text_name = f"c{docs.columns.index(text_column)}"
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = F.coalesce(F.col(text_name).cast("string"), F.lit(""))
    kept = [c for c in numbered.columns if keep_text or c != text_name]
    based = numbered.select(*kept, text.alias("text_"), base_spans(text).alias("base"))
    found = based.select(*kept, "base", candidates(F.col("text_"), F.col("base")).alias("candidates"))
    if keep_text:
        folder = f"{work_folder(docs.sparkSession)}/spans"
        found.write.parquet(folder)
        found = docs.sparkSession.read.schema(found.schema).parquet(folder)
    else:
        found = pin(found)
    model = fit(found)
    if model is None:
        added = F.array().cast(f"array<{SPAN}>")
    else:
        likely = F.filter("candidates", lambda x: _score(x, model) >= threshold)
        added = _of_kind(likely, len(BASE_KINDS))
    return found.withColumn("all", F.sort_array(F.concat("base", added)))


def personal_data(
    docs: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other) of every row.

    Base spans are the stated patterns' matches that pass their checks; ``spans`` lists
    them and the spans of kind ``other`` that the method adds, as kind:start:end in code
    points.  Null and empty texts have none.  Repeated rows get the same result; other
    columns are not read.
    """
    found = found_spans(docs.select(id_column, text_column), text_column, threshold)
    number = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("c0").alias(id_column),
        *(number("base", kind).alias(f"n_{name}") for kind, name in enumerate(BASE_KINDS)),
        F.sha2(_listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        _listed(F.col("all"), KINDS).alias("spans"),
        number("all", len(BASE_KINDS)).alias("n_other"),
    )


def redact(text: Column, spans: Column, names: tuple[str, ...] = KINDS) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlaps become one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(
        spans,
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["parts"],
                    F.array(
                        F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                        F.concat(
                            F.lit("["),
                            F.upper(F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1)),
                            F.lit("]"),
                        ),
                    ),
                ).alias("parts"),
            ),
        ).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        ),
        lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, parts).otherwise(text)


def redacted(docs: DataFrame, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, in the same columns; null texts stay null."""
    found = found_spans(docs, text_column, threshold, keep_text=True)
    text = f"c{docs.columns.index(text_column)}"
    new = F.when(F.col(text).isNotNull(), redact(F.col(text), F.col("all")))
    return found.withColumn(text, new).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns))
    )
