"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document on its own. A rule's cost and selectivity (share rejected) are estimated on a sample, in one
job; the cascade tests rules in order of rejection per cost, and a CASE stops at the first that rejects. Cost is counted,
not timed: the characters that the rule looks at beyond the base counts, times its steps for each, so one table has one
order. The order changes the work only: ``kept`` is the conjunction of all rules in any order.

Defined results: a null or empty text has no words and fails the base rule; repeated rows each get their own row;
an empty table gives an empty result; extra columns are left out of ``measure`` and kept by ``keep_documents``.
Windows of words are compared by a 64-bit hash over their five words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated; longer texts are left out of that sample.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 50_000


@dataclass(frozen=True)
class Rule:
    """``sql``: true of a document to reject, over the base counts and ``extra``.

    ``extra``: name of the one further count that the rule needs, from the text ``_t``, its words ``_w`` and its lines
    ``_l``. It stands inside the cascade's CASE and so is computed only if no earlier rule rejects.
    ``work``: SQL of the steps that takes; a step is about what looking at one character costs.
    """

    name: str
    sql: str
    extra: str = ""
    work: str = "1"

    @property
    def rejects(self) -> Column:
        if self.extra == "n_repeat_words":
            return let(let(F.col("_w"), _repeat_words), lambda n: 100 * n > 20 * F.col("n_words"))
        return F.expr(self.sql.replace(self.extra, f"({EXTRA[self.extra]})") if self.extra else self.sql)


#: Counts beyond the base, as SQL over ``_t``, ``_w`` and ``_l``.
EXTRA = {
    "n_lines": "size(_l)",
    "n_upper": "length(regexp_replace(_t, '[^A-ZÀ-Þ]+', ''))",
    "n_adjacent": "size(filter(_w, (x, i) -> x = get(_w, i - 1)))",
    "n_distinct": "size(array_distinct(_w))",
}
RULES = (
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbol_share", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_lines", "2"),
    Rule("upper_case_share", "word_chars > 20 AND 10 * n_upper > 5 * word_chars", "n_upper", "length(_t)"),
    Rule("adjacent_repeats", "10 * n_adjacent > 4 * n_words", "n_adjacent", "2 * word_chars"),
    # distinct words grow about as the root of the length, so beyond 2,304 words the root takes over from a twelfth
    Rule("distinct_words", "n_words >= 50 AND n_distinct < least(n_words / 12e0, 4e0 * sqrt(n_words))", "n_distinct", "2 * word_chars"),
)
#: The base rule in two parts, for a cascade that need not return the base counts.
BASE = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", "n_repeat_words", "8 * word_chars"),
)


def _repeat_words(w: Column) -> Column:
    """Words in 5-word windows that the text has twice or more. Linear in the text but for one sort of the windows,
    and that sort is reached only if a window repeats."""
    hashes = F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def in_groups(s: Column) -> Column:
            again = F.filter(
                s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"])
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def span(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, in_groups), span)

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def measure(docs: DataFrame, carried: list[Column], *, text_col: str = "text", windows: bool = True) -> DataFrame:
    """``carried``, the five base counts (long; that of repeated windows, the dear one, if wanted), and the arrays from
    which rules count further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    # one projection after another, so that each array is built once
    base = docs.select(*carried, text.alias("_t"), words(F.col(text_col)).alias("_w"), lines.alias("_l"))
    return base.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        *([let(F.col("_w"), _repeat_words).alias("n_repeat_words")] if windows else []),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def order_rules(docs: DataFrame, *, text_col: str = "text", given: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejection per cost, both estimated on a bounded sample of the table."""
    total = docs.count()
    t = F.col(text_col)
    sample = (
        docs.select(t.alias("text"))
        .sample(min(1.0, 3 * SAMPLE_ROWS / max(1, total)), seed=7)
        .where(t.isNotNull() & (F.length(t) <= SAMPLE_CHARS))
        .orderBy(F.xxhash64("text"), "text")
        .limit(SAMPLE_ROWS)
    )
    sums = [x for r in given for x in (F.count_if(r.rejects), F.sum(F.expr(f"cast({r.work} as long)")))]
    found = measure(sample, [], windows=False).agg(*sums).first()
    gain = {r.name: found[2 * i] / max(1, found[2 * i + 1] or 0) for i, r in enumerate(given)}
    return sorted(given, key=lambda r: (-gain[r.name], r.name))


def cascade(ordered: list[Rule], base: bool = True) -> Column:
    """Name of the first rule in the cascade that rejects, null if none does; first of all the base rule, if wanted."""
    out = F.when(base_failed() if base else F.lit(False), F.lit("base"))
    for r in ordered:
        out = out.when(r.rejects, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, and kept: whether the cascade ends without a rejection."""
    ordered = order_rules(docs, text_col=text_col)
    return measure(docs, [F.col(id_col).alias("doc_id")], text_col=text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), cascade(ordered).isNull().alias("kept"),
    )


def keep_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they were."""
    ordered = order_rules(docs, text_col=text_col, given=(*RULES, *BASE))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = measure(docs, [row], text_col=text_col, windows=False)
    # a filter would be pushed below the counts and compute each anew wherever it is named; exploding none or one row isn't
    return measured.select(F.explode(F.when(cascade(ordered, base=False).isNull(), F.array("_row"))).alias("_row")).select("_row.*")


_DUCK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_DUCK_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
adj AS (SELECT doc_id, count(*) AS n_adjacent
        FROM (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d) WHERE w[i] = w[i-1] GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z\x{{C0}}-\x{{DE}}]+', '', 'g')) AS n_upper,
    coalesce(n_adjacent, 0) AS n_adjacent, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN adj USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(f"({r.sql})" for r in RULES)}) AS kept FROM b
"""
