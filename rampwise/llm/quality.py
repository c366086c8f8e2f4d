"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule names a measure and the range it must stay in. Measures are column expressions
over the words and lines of the whole text; no user function runs. A document is kept if
it passes the base rules and all rules of the table.

Null and empty texts have no words: every count is 0, the base fails, ratios are null and
a null measure passes its rule. Repeated rows, ids and extra columns change nothing; an
empty table gives an empty result. Repeated windows are told by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampwise.llm.common import WHITE, once, whole

#: Common function words of four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on are this be by or at not an a from",
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als es an in",
    "de la le et les des en un du une que est pour qui dans par sur pas au il à",
    "de la que el en y a los del se las por un para con no una su al lo es",
)
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`measure` must lie in [least, most] where the text has at least `words` words."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: Wide on purpose: running prose of any of the languages passes, in small letters or capitals.
RULES = (
    Rule("mean word length", "mean_word", 1.5, 14.0),
    Rule("symbols per word", "symbols_per_word", most=0.3),
    Rule("stop words", "stop_share", least=0.01, words=50),
    Rule("repeated lines", "dup_line_share", most=0.5),
    Rule("words with a letter", "letter_share", least=0.5),
    Rule("lines that end in an ellipsis", "ellipsis_share", most=0.5),
    Rule("lines that begin with a bullet", "bullet_share", most=0.9),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The table as one condition."""
    passed = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.least is not None:
            inside &= F.col(r.measure) >= r.least
        if r.most is not None:
            inside &= F.col(r.measure) <= r.most
        passed &= (F.col("n_words") < r.words) | F.coalesce(inside, F.lit(True))
    return passed


def window_hashes(words: str, window: int) -> Column:
    """A hash of each run of `window` words."""
    n = F.size(words)
    return F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(F.col(words), i, window)))).otherwise(
        F.array().cast("array<bigint>"))


def repeated_at(found: str) -> Column:
    """From (hash, place) in order of hash: the places whose hash occurs twice or more, in order."""
    last = F.size(found) - 1
    again = F.filter(F.col(found), lambda x, k: ((k > 0) & (F.get(F.col(found), k - 1)["h"] == x["h"])) | ((k < last) & (F.get(F.col(found), k + 1)["h"] == x["h"])))
    return F.array_sort(F.transform(again, lambda x: x["i"]))


def covered(at: str, window: int) -> Column:
    """How many words the windows at these places cover, each word once."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("end"))
    return F.aggregate(F.col(at), zero, lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(window), i + window - acc["end"])).cast("long").alias("n"), (i + window).alias("end")), lambda acc: acc["n"])


def measured(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All measures of every document."""
    stops = sorted({w for line in STOP_WORDS for w in line.split()})
    d = docs.select(F.col("doc_id"), whole(text).alias("text"))
    d = d.select("doc_id", "text", once(F.filter(F.split("text", f"[{WHITE}]+"), lambda w: w != "")).alias("words"),
                 once(F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))).alias("lines"))
    d = d.select("*", once(window_hashes("words", window)).alias("windows"), F.size("words").cast("long").alias("n_words"), F.size("lines").alias("n_lines"),
                 F.char_length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    share = lambda of, n: F.when(F.col(n) > 0, of / F.col(n))
    # only texts in which a window repeats have theirs sorted
    placed = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.withColumn("windows", once(placed))
    d = d.withColumn("windows", once(repeated_at("windows")))
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered("windows", window).alias("n_repeat_words"),
        share(F.col("word_chars"), "n_words").alias("mean_word"), share(F.col("n_symbols"), "n_words").alias("symbols_per_word"),
        share(F.size(F.filter("words", lambda w: F.lower(F.rtrim(w, F.lit(".,!?;:"))).isin(*stops))), "n_words").alias("stop_share"),
        share(F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))), "n_words").alias("letter_share"),
        share(F.col("n_lines") - F.size(F.array_distinct("lines")), "n_lines").alias("dup_line_share"),
        share(F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))), "n_lines").alias("ellipsis_share"),
        share(F.size(F.filter("lines", lambda x: x.rlike(f"^[{WHITE}]*[-*•]"))), "n_lines").alias("bullet_share"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the measured ratios."""
    m = measured(docs, text=text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                    (~base & compiled(rules)).alias("kept"))
