"""Quality rules: a table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

BLANKS = r"[\x20\x09-\x0D]+"

# Frequent words of four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be", "this", "have", "from", "or",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "nicht", "ein", "eine", "zu", "im", "auf", "für",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "du", "pas", "elle", "dans",
    "el", "los", "las", "y", "en", "por", "para", "una", "no", "su", "se", "con", "como",
)


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * ``part`` / ``whole`` <= ``high``; a bound that is None does not bind.

    Compared as whole numbers, so that no rounding decides; a rule holds where ``whole`` is
    below ``at_least``, as a share of a handful says little."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    at_least: int = 1


#: The measures that rules may name are the columns that ``measures`` makes.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=150, high=1500),
    Rule("symbols to words", "n_symbols", "n_words", high=10),
    Rule("exclamation marks to words", "n_exclamations", "n_words", high=20),
    Rule("stop words to words", "n_stop_words", "n_words", low=2, at_least=50),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", high=30, at_least=10),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words", "n_lines")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id and the measures of each whole text, as longs, in projections over the scan.

    Every array that a lambda reads is a column of the projection below, so it is made once
    per row. Repeated windows: equal ones are neighbours once sorted by words and place, and
    each of them adds the words up to the next one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumns({
        "words": F.filter(F.split("text", BLANKS), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    none = F.array().cast("array<int>")
    places = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width)).otherwise(none)
    d = d.withColumn("windows", F.transform(places, lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(width)])))
    pairs = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.size("windows") > F.size(F.array_distinct("windows")), pairs))

    def repeated(x: Column, k: Column) -> Column:
        def same(other: Column) -> Column:
            return F.coalesce(F.get(F.col("pairs"), other)["w"] == x["w"], F.lit(False))

        return same(k - 1) | same(k + 1)

    d = d.withColumn("at", F.array_sort(F.transform(F.filter("pairs", repeated), lambda x: x["i"])))
    steps = F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(width), F.get(F.col("at"), k + 1) - p), F.lit(width)))
    stop = F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))

    def without(pattern: str) -> Column:
        return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))

    made = {
        "n_words": F.size("words"), "word_chars": F.length(F.array_join("words", "")), "n_symbols": without("[#*$%&|<>]+"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda acc, s: acc + s), F.lit(0)),
        "n_exclamations": without("!+"), "n_stop_words": F.size(stop), "n_lines": F.size("lines"),
    }
    return d.select("doc_id", *[made[m].cast("long").alias(m) for m in MEASURES])


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column: every rule holds."""
    holds = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        if r.low is not None:
            holds = holds & ((whole < r.at_least) | (part >= whole * r.low))
        if r.high is not None:
            holds = holds & ((whole < r.at_least) | (part <= whole * r.high))
    return holds


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a document breaks."""
    return F.filter(F.array(*[F.when(~verdict((r,)), r.name) for r in rules]), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rules, one row per row of ``docs``.

    base_failed: fewer than ten words, or more than a fifth of the words in repeated five-word
    windows. A null text counts as an empty one, which has no words and fails; null ids and
    repeated rows are judged like others. Other columns are not read. No rows give no rows.
    """
    m = measured(docs).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    return m.select("*", (~F.col("base_failed") & verdict(rules)).alias("kept"), failed_rules(rules).alias("failed_rules"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the documents that the rules reject: a filter on the scan, no shuffle."""
    key = fresh(docs, "kept_by_rules")
    whole = docs.withColumn(key, F.struct(*docs.columns))
    judged = measured(whole, id_col=key).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    # a filter on these columns would be pushed below them and make their arrays once per element
    row = F.explode_outer(F.when(~F.col("base_failed") & verdict(rules), F.array("doc_id"))).alias("row")
    return judged.select(row).where("row is not null").select("row.*")


def _sql_verdict(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(f"({r.whole} < {r.at_least} OR 100 * {r.part} >= {r.low} * {r.whole})")
        if r.high is not None:
            parts.append(f"({r.whole} < {r.at_least} OR 100 * {r.part} <= {r.high} * {r.whole})")
    return " AND ".join(parts)


SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM repeated) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines
  FROM split s LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_sql_verdict()} AS kept
FROM judged
"""
