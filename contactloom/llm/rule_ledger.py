"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps its measurements and one bit for each rule that failed.
Policies are masks over these bits, so that a new policy version or an ablation needs no second look at any text.
All of it is DataFrame functions, and narrow: no shuffle but that of the few distinct bit patterns in an ablation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits; each is true where a document fails it.  Only integer arithmetic.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "10 * n_shouts > n_words",
    "capitals": "10 * n_capital_runs > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "bullets": "10 * n_bullets > 9 * n_lines",
    "ellipses": "10 * n_ellipses > 3 * n_lines",
    "digits": "2 * n_digits > word_chars",
    "stop_words": "n_stop_words < 2",
}

#: Policy versions: the rules of which none may fail.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "capitals", "repeated_lines", "word_length"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "capitals", "repeated_lines", "word_length", "bullets", "ellipses", "digits"),
    "strict": tuple(RULES),
}
#: The policy in force.
CURRENT = "v2"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_capital_runs", "n_bullets", "n_ellipses", "n_digits", "n_stop_words",
)

# Words that prose of some languages can hardly do without, in small letters.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "with", "der", "die", "das", "und", "ein", "ist", "le", "la", "les", "et", "de", "des", "est", "el", "los", "y", "en", "que", "un",
)


def bit(rule: str) -> int:
    """The rule's bit."""
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(bit(rule) for rule in POLICIES[policy])


def _covered(windows: Column) -> Column:
    """Words in windows whose hash stands twice or more: sorted, equal hashes are neighbours."""
    return F.size(F.array_distinct(F.flatten(F.transform(windows, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the columns of MEASURES (long) and `fail_bits` (long), a row for each input row.

    Words are maximal runs of characters other than space and tab to carriage return.  Windows of three words are
    compared by 64-bit hashes within their document.  A null text is an empty one: it has no words and fails few_words.
    Input columns of the new names, in any case, are replaced; all others stay; an empty table gives an empty one.
    """
    made = {*MEASURES, "fail_bits"}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    free = "_"
    while any(c.lower().startswith(f"{free}l_") for c in df.columns):
        free += "_"
    words_, windows_, sorted_, lines_ = (f"{free}l_{x}" for x in ("words", "windows", "sorted", "lines"))
    long = lambda c, name: c.cast("long").alias(name)
    # Each step's arrays are used more than once below; a select of its own keeps them from being computed again.
    words = df.select(
        *kept,
        F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "").alias(words_),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines_),
        long(F.regexp_count(body, F.lit(r"[#*$%&|<>]")), "n_symbols"),
        long(F.regexp_count(body, F.lit("!!")), "n_shouts"),
        long(F.regexp_count(body, F.lit(r"\p{Lu}{2,}")), "n_capital_runs"),
        long(F.char_length(body) - F.char_length(F.translate(body, "0123456789", "")), "n_digits"),
    )
    bullet = lambda line: line.rlike(r"^[\x20\x09]*(?:[-*+•]|[0-9]+[.)])[\x20\x09]")
    ellipsis = lambda line: line.rlike(r"(?:\.\.\.|…)[\x20\x09\x0D]*$")
    windows = words.select(
        *kept, words_, "n_symbols", "n_shouts", "n_capital_runs", "n_digits",
        long(F.size(words_), "n_words"),
        long(F.char_length(F.array_join(words_, "")), "word_chars"),
        long(F.size(lines_), "n_lines"),
        long(F.size(lines_) - F.size(F.array_distinct(lines_)), "n_dup_lines"),
        long(F.size(F.filter(lines_, bullet)), "n_bullets"),
        long(F.size(F.filter(lines_, ellipsis)), "n_ellipses"),
        long(F.size(F.array_intersect(words_, F.array(*map(F.lit, STOP_WORDS)))), "n_stop_words"),
        F.transform(
            F.slice(F.col(words_), 1, F.greatest(F.size(words_) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(F.col(words_), i + 1), F.get(F.col(words_), i + 2)),
        ).alias(windows_),
    )
    in_order = windows.withColumn(
        sorted_,
        F.when(
            F.size(F.array_distinct(windows_)) < F.size(windows_),
            F.sort_array(F.transform(F.col(windows_), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    near = lambda e, j, step: F.coalesce(F.get(F.col(sorted_), j + step)["h"] == e["h"], F.lit(False))
    again = F.filter(F.col(sorted_), lambda e, j: near(e, j, 1) | near(e, F.greatest(j, F.lit(1)), -1) & (j > 0))
    measured = in_order.withColumn("n_repeat_words", F.when(F.col(sorted_).isNull(), 0).otherwise(_covered(again)).cast("long"))
    bits = sum((F.when(F.expr(f"({fails})"), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, fails in RULES.items()), F.lit(0))
    return measured.select(*kept, *MEASURES, bits.cast("long").alias("fail_bits"))


def passes(policy: str) -> Column:
    """Whether a row of the ledger fails none of the policy's rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def failed_alone(policy: str) -> Column:
    """The bit of the one rule of the policy that a row fails, without which it would be kept; 0 if it fails none or several."""
    seen = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    return F.when(F.bit_count(seen) == 1, seen).otherwise(F.lit(0)).cast("long")


def apply_policy(df: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of `df` that a policy keeps, with their own columns; nulls and empty texts fail few_words."""
    judged = ledger(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").alias("_text")), "_text")
    # A filter is not moved below a column that is not deterministic; moved, it would compute the ledger once more.
    return judged.withColumn("_at", F.monotonically_increasing_id()).where(passes(policy) & (F.col("_at") >= 0)).select("_row.*")


def ablations(judged: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_failed_alone (kept if this rule were dropped), n_kept, n_rows (long).

    Documents are first counted by bit pattern, so that what is shuffled is a row for each pattern and task.  An empty
    ledger gives a row for each rule, of zeros.
    """
    counts = judged.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            total(F.col("fail_bits").bitwiseAND(F.lit(bit(rule))) != 0).alias("n_failed"),
            total(seen == bit(rule)).alias("n_failed_alone"),
            total(seen == 0).alias("n_kept"),
            total(F.lit(True)).alias("n_rows"),
        )
        for rule in POLICIES[policy]
    ]
    return counts.agg(*[e.alias(f"_{k}") for k, e in enumerate(each)]).select(F.inline(F.array(*[f"_{k}" for k in range(len(each))])))
