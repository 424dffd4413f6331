"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged by punctuation, navigation and boilerplate rules; lines that fail go, and a document that loses
too large a share of its word characters is rejected. Two base rules come first: too few words, or too many words in five-word
windows that the text holds more than once.

A line fails when it has a word and
  * shouting: it has more of A-Z than of a-z, and at least eight of them;
  * punctuation: more than a fifth of its words end with a run of exclamation or question marks, or more than a tenth of its
    word characters are among # * $ % & | < >;
  * navigation: it has at most twelve words, no closing punctuation, and holds a separator of a menu or breadcrumb trail;
  * boilerplate: it holds one of the phrases of BOILERPLATE;
  * repetition: it equals an earlier line of the text.

Words are runs of characters other than space and U+0009 to U+000D; lines are parted by U+000A. Cases: a null or empty text has
no words and fails the base rules; equal rows get equal results, one row out for each row in; one long line is judged as a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, blank_null, whole_row

# fixed values: the word and symbol classes of the contract
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Parameters of the method.
MAX_LOST_PERCENT = 50
CLOSING = r"[.!?:;,\x22')\]…”’»]$"
MENU = r"[|›»→]| > | / | · "
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "licensed under", "subscribe to our", "sign up for", "skip to content",
    "click here", "lorem ipsum", "copyright (c)", "powered by",
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words of an array are in windows found twice or more in it."""

    def marked(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return bind(bind(ordered, starts), covered)

    def grams_of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))

    def counted(h: Column) -> Column:
        found = bind(grams_of(h), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), marked(g)).otherwise(F.lit(0).cast("bigint")))
        return F.when(F.size(h) < window, F.lit(0).cast("bigint")).otherwise(found)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), counted)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, pattern: str) -> Column:
    """The length of a text without the runs of a pattern: fewer matches than one for each character."""
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule other than repetition."""
    upper = F.length(line) - _without(line, "[A-Z]+")
    words = _count(line, f"{NON_SPACE}+")
    shouting = (upper >= 8) & (upper > F.length(line) - _without(line, "[a-z]+"))
    punctuation = (5 * _count(line, rf"[!?]{{2,}}({SPACE}|$)") > words) | (10 * _count(line, SYMBOLS) > _without(line, f"{SPACE}+"))
    navigation = (words <= 12) & ~F.rtrim(line).rlike(CLOSING) & line.rlike(MENU)
    boilerplate = bind(F.lower(line), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    return shouting | punctuation | navigation | boilerplate


def clean_lines(text: Column) -> Column:
    """array<string>: the lines that stay, in order. Of equal lines only the first can; lines without a word go."""
    return F.filter(F.array_distinct(F.split(text, "\n")), lambda x: x.rlike(NON_SPACE) & ~line_fails(x))


def judge(df: DataFrame) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text"]
    text = blank_null()
    full = bind(F.split(text, "\n"), lambda a: bind(F.filter(a, lambda x: x.rlike(NON_SPACE)), lambda b: F.size(b) - F.size(F.array_distinct(b))))
    counts = bind(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    # the row as one struct, so that no column of the input meets a name used here
    base = df.select(
        whole_row(df, *made).alias("row"), _count(text, SYMBOLS).cast("bigint").alias("n_symbols"), full.cast("bigint").alias("n_dup_lines"), F.array_join(clean_lines(text), "\n").alias("clean_text"), counts.alias("counts")
    )
    n_words, chars, again = (F.col(f"counts.{c}") for c in ("n_words", "word_chars", "n_repeat_words"))
    failed = (n_words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n_words)
    out = base.withColumns({"base_failed": failed, "lost_chars": chars - _without(F.col("clean_text"), f"{SPACE}+")})
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * chars)
    return out.select("row.*", n_words.alias("n_words"), chars.alias("word_chars"), "n_symbols", "n_dup_lines", again.alias("n_repeat_words"), "base_failed", "lost_chars", kept.alias("kept"), "clean_text")
