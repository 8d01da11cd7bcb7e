"""Quality rules as a short-circuit cascade of Spark expressions, ordered by rejection per cost.

Words are `[^\\x20\\x09-\\x0D]+`. Every document gets its base features; the base rules decide first, then the
cascade: a chain of conditions in which a later rule is computed only for rows that every earlier rule let pass.
The order comes from a sample of about `SAMPLE_ROWS` rows at any size (one in so many, by a hash of doc_id and text), in one job: each rule is
evaluated `REPEATS` times on each row between two readings of the clock, one rule after the other, and the least of these times, less that of
an empty rule, counts. So what a job, a busy machine or a collection of garbage takes is nobody's cost. A rule's selectivity is
that on the rows which the base and the rules before it let pass: the combinations of rules that reject a row are counted once, and the
rule with most rejections for its cost comes first, then the best of what is left. The order changes what is computed, never the verdict.

Defined cases: null and empty texts have zero of everything and fail the base; ties and repeated rows are judged
alike, row by row; an empty table gives no rows; other columns are ignored. No step shuffles the documents.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import documents, words

SAMPLE_ROWS = 2_000
#: How often a rule is timed on a row of the sample; the least cost of a rule on a row, in nanoseconds.
REPEATS, LEAST_NS = 5, 10
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """fails: a boolean column over w (words), lines, text, and the base features."""

    name: str
    fails: Column


def cascade_rules() -> list[Rule]:
    n = F.col("n_words")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n * 3),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20)),
        Rule("dup_lines", F.col("n_dup_lines") * 10 > F.size("lines") * 5),
        Rule("letters", letters * 10 < F.col("word_chars") * 6),
        Rule("shouting", upper * 10 > letters * 5),
        Rule("distinct_words", F.size(F.array_distinct("w")) * 10 < F.least(n, F.lit(1000)) * 1),
        Rule("one_long_word", F.array_max(F.transform("w", F.length)) > 1000),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """Adds w, lines (with a word), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    n_repeat_words: hashes of all three-word windows are sorted with their places; a window equal to a neighbour in
    that order is a repeat, and the words of repeats are counted by walking their places in order.
    """
    docs = docs.withColumn("w", words(F.col("text")))
    docs = docs.withColumn(
        "lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    )
    hashes = F.expr(
        "if(size(w) < 3, cast(array() as array<bigint>),"
        " transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    )
    docs = docs.withColumn("h", hashes).withColumn("n_words", F.size("w").cast("long"))
    # Only texts in which some window occurs twice need the places.
    docs = docs.withColumn(
        "sorted",
        F.expr("if(size(array_distinct(h)) = size(h), null, array_sort(transform(h, (x, i) -> struct(x as x, i as i))))"),
    )
    places = F.expr(
        "array_sort(transform(filter(transform(sorted, (s, k) -> struct(s.i as i,"
        " (k > 0 and sorted[greatest(k - 1, 0)].x = s.x) or coalesce(get(sorted, k + 1).x = s.x, false) as r)),"
        " s -> s.r), s -> s.i))"
    )
    docs = docs.withColumn("places", places)
    covered = F.expr(
        "coalesce(aggregate(transform(places, (p, k) -> least(3, coalesce(get(places, k + 1), p + 3) - p)), 0L, (a, x) -> a + x), 0L)"
    )
    return docs.withColumns(
        {
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("h", "sorted", "places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def by_worth(costs: list[float], rejected: dict[int, int]) -> list[tuple[int, int]]:
    """(rule, rejections) in the order that pays most. rejected: how many rows each set of rules, as bits, would reject."""
    out, left = [], dict(rejected)
    rest = list(range(len(costs)))
    while rest:
        hits = {k: sum(n for mask, n in left.items() if mask >> k & 1) for k in rest}
        best = max(rest, key=lambda k: (hits[k] / costs[k], -costs[k], -k))
        out.append((best, hits[best]))
        rest.remove(best)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return out


def clock() -> Column:
    return F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def timed(fails: Column, repeats: int = REPEATS) -> Column:
    """struct(ns, fails): the least time of so many evaluations on a row, and the outcome.

    Inside a lambda an expression is evaluated each time that the lambda is, and a struct's fields in order.
    """
    readings = F.transform(
        F.sequence(F.lit(1), F.lit(repeats)),
        lambda _: F.struct(clock().alias("began"), F.coalesce(fails, F.lit(False)).alias("fails"), clock().alias("ended")),
    )
    return F.array_min(F.transform(readings, lambda r: F.struct((r.ended - r.began).alias("ns"), r.fails.alias("fails"))))


def measured(featured: DataFrame, rules: list[Rule]) -> tuple[list[float], dict[int, int]]:
    """Of rows with features that the base lets pass: nanoseconds a row of each rule, and how many rows each set of rules, as bits, rejects. One job."""
    names = [f"_rule{k}" for k in range(len(rules))]
    read = featured.select(base_failed().alias("_out"), timed(F.lit(False)).alias("_empty"), *(timed(r.fails).alias(c) for c, r in zip(names, rules, strict=True)))
    mask = reduce(Column.bitwiseOR, (F.when(F.col(c).fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(names)))
    own = read.select("_out", mask.alias("_mask"), *((F.col(c).ns - F.col("_empty").ns).alias(c) for c in names))
    found = [r for r in own.groupBy("_out", "_mask").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).collect() if not r["_out"]]  # a row for each set
    n = sum(r.n for r in found)
    return [max(sum(r[c] for r in found) / max(n, 1), LEAST_NS) for c in names], {r["_mask"]: r.n for r in found}


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections for their cost on the sample, each on what those before it let pass."""
    every = max(1, docs.count() // sample_rows)
    each, rejected = measured(with_features(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")), rules)
    order = by_worth(each, rejected)
    for k, n in order:
        logging.getLogger(__name__).info("rule %s: %.0f ns a row of the sample, rejects %d of what is left", rules[k].name, each[k], n)
    return [rules[k] for k, _ in order]


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text) with features, base_failed, kept; rules are tried in the order that pays most."""
    rules = ordered(docs, cascade_rules() if rules is None else rules, sample_rows)
    verdict = F.when(base_failed(), False)
    for rule in rules:
        verdict = verdict.when(rule.fails, False)
    return with_features(docs).withColumns({"base_failed": base_failed(), "kept": verdict.otherwise(True)}).drop("w", "lines")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP8_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as l,
    row_number() over () as k
  from documents
), win as (
  select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select k, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), rep as (select k, i from win qualify count(*) over (partition by k, a, b, c) > 1),
cov as (select k, count(distinct i + o) as n from rep, (select unnest([0, 1, 2]) as o) group by k),
f as (
  select doc_id, text, w, l, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
    length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as upper_
  from d left join cov using (k)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols * 10 > n_words * 3
    or word_chars < n_words * 2 or word_chars > n_words * 20 or n_dup_lines * 10 > len(l) * 5
    or letters * 10 < word_chars * 6 or upper_ * 10 > letters * 5
    or len(list_distinct(w)) * 10 < least(n_words, 1000)
    or list_max(list_transform(w, lambda x: length(x))) > 1000) as kept
from f
"""
