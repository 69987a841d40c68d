"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over the whole text, and every rule is
one row of ``RULES``: a statistic, what it is divided by, and inclusive bounds in
thousandths. Integers only, so a text on a bound is judged the same everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import bind, shielded, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was it for with that this be as by on are from at or an he "
    "le la les de des du et en un une que qui dans pour par sur avec est au aux "
    "der die das und von zu den mit sich auf für ist nicht ein eine als auch dem "
    "el los las del y una se con para por su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= 1000 * value / per <= ``high``; a text with ``per`` of zero passes."""

    name: str
    value: str
    per: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2500, high=12000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("capitals", "n_capitals", "word_chars", high=300),
    Rule("exclamations", "n_exclamations", "n_words", high=200),
    Rule("stop_words", "n_stop_words", "n_words", low=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
)


def _chars_in(text: Column, kept: str) -> Column:
    """How many characters of ``text`` the negated class ``kept`` leaves."""
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


def _windows(words: Column) -> Column:
    """A hash of each window of words, by where it begins."""
    n = F.size(words)
    every = bind(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda hashes: F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))
        ),
    )
    return F.when(n >= WINDOW, every)


def _repeated_starts(pairs: Column) -> Column:
    """Where the windows begin whose hash is also that of a neighbour in the sorted (hash, start) pairs."""
    last = F.size(pairs) - 1
    twice = F.filter(
        pairs,
        lambda e, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == e["h"]))
        | ((k < last) & (F.get(pairs, k + 1)["h"] == e["h"])),
    )
    return F.sort_array(F.transform(twice, lambda e: e["i"]))


def _covered(starts: Column) -> Column:
    """How many words the windows that begin at the sorted ``starts`` cover."""
    rest = F.size(starts) - 1
    steps = F.zip_with(
        F.slice(starts, F.lit(2), rest), F.slice(starts, F.lit(1), rest), lambda b, a: F.least(b - a, F.lit(WINDOW))
    )
    return F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x).cast("long")


HELPERS = ("_words", "_lines", "_windows", "_pairs", "_starts")
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines",
    "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words", "base_failed", "failed", "kept", "_kept",
)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counted columns; a null text counts as one without words."""
    return shielded(docs, HELPERS, _counted)


def _counted(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn("_words", words_of(text)).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = base.withColumn("_windows", _windows(F.col("_words"))).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _chars_in(text, r"[^#*$%&|<>]+"),
            "n_capitals": _chars_in(text, r"[^A-Z]+"),
            "n_exclamations": _chars_in(text, r"[^!]+"),
            "n_stop_words": F.size(F.filter("_words", lambda x: x.isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-•*]\s"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long"),
        }
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return (
        counted.withColumn("_pairs", F.when(repeats, pairs))
        .withColumn("_starts", _repeated_starts(F.col("_pairs")))
        .withColumn("n_repeat_words", F.coalesce(F.when(F.col("_starts").isNotNull(), _covered(F.col("_starts"))), F.lit(0)))
        .drop("_words", "_lines", "_windows", "_pairs", "_starts")
    )


def _passes(rule: Rule) -> Column:
    value, per = F.col(rule.value) * 1000, F.col(rule.per)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= per * rule.low)
    if rule.high is not None:
        ok = ok & (value <= per * rule.high)
    return (per == 0) | ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed`` (comma-joined rules) and ``kept``.

    One projection without a shuffle. Null and empty texts have no words and fail
    the base; repeated rows are judged alike, one by one; other columns stay, and
    columns of the same names as the results are replaced.
    """
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    failed = F.concat_ws(",", *[F.when(~_passes(r), F.lit(r.name)) for r in rules])
    return (
        statistics(docs)
        .withColumns({"base_failed": base, "failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, as they are.

    The verdict is taken with a row number that never changes it: a filter on
    plain expressions would move below the projection and count everything again
    for each rule. Columns named as the counts stay as they are.
    """

    def kept(rows: DataFrame) -> DataFrame:
        judged = judge(rows).withColumn("_kept", F.when(F.monotonically_increasing_id() >= 0, F.col("kept")))
        return judged.filter("_kept").select(rows.columns)

    return shielded(docs, HELPERS + RESULTS, kept)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rows(docs: DataFrame) -> DataFrame:
    """The digest of ``judge``: one row for each row of ``documents``."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "failed", "kept")


def _sql_rule(r: Rule) -> str:
    tests = [f"{r.value} * 1000 >= {r.per} * {r.low}"] * (r.low is not None)
    tests += [f"{r.value} * 1000 <= {r.per} * {r.high}"] * (r.high is not None)
    return f"CASE WHEN NOT ({r.per} = 0 OR ({' AND '.join(tests)})) THEN '{r.name}' END"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: The counts and the verdict as DuckDB SQL over the view or table ``{docs}``.
JUDGED_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r_, * FROM {{docs}}),
cut AS (
  SELECT *, coalesce(text, '') AS t_,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w_,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l_
  FROM rows_),
windows_ AS (
  SELECT r_, i_, array_to_string(list_slice(w_, i_, i_ + {WINDOW - 1}), ' ') AS s_
  FROM (SELECT r_, w_, unnest(range(1, len(w_) - {WINDOW - 2})) AS i_ FROM cut WHERE len(w_) >= {WINDOW})),
starts_ AS (SELECT r_, i_ FROM windows_ QUALIFY count(*) OVER (PARTITION BY r_, s_) > 1),
repeats_ AS (
  SELECT r_, sum(least({WINDOW}, step_)) AS n_
  FROM (SELECT r_, coalesce(lead(i_) OVER (PARTITION BY r_ ORDER BY i_) - i_, {WINDOW}) AS step_ FROM starts_)
  GROUP BY r_),
counted AS (
  SELECT c.* EXCLUDE (t_, w_, l_),
    len(w_)::BIGINT AS n_words, length(array_to_string(w_, ''))::BIGINT AS word_chars,
    length(regexp_replace(t_, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t_, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(t_, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
    len(list_filter(w_, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
    len(l_)::BIGINT AS n_lines, (len(l_) - len(list_distinct(l_)))::BIGINT AS n_dup_lines,
    len(list_filter(l_, lambda x: regexp_matches(x, '^\\s*[-•*]\\s')))::BIGINT AS n_bullet_lines,
    len(list_filter(l_, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))::BIGINT AS n_ellipsis_lines,
    coalesce(n_, 0)::BIGINT AS n_repeat_words
  FROM cut c LEFT JOIN repeats_ USING (r_)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    concat_ws(',', {", ".join(_sql_rule(r) for r in RULES)}) AS failed
  FROM counted)
"""

QUALITY_SQL = (
    JUDGED_SQL.format(docs="documents")
    + f"SELECT doc_id, {', '.join(COUNTS)}, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM judged"
)
