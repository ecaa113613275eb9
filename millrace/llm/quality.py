"""Quality rules: base counts of a text, and its likelihood under trusted against raw text.

Words and runs of signs of a text, and pairs of neighbours, are hashed into
BUCKETS cells. Counts over the cells give two multinomials: one of all documents,
one of all trusted documents (those labelled good). A document's score is the mean log ratio of the two over its cells; it is
kept if the base rules pass and the score reaches THRESHOLD. The decision depends
on the document and the counts alone.

Everything runs in DataFrame functions. Only the BUCKETS counts visit the driver,
a fixed number. Trusted ids are joined by a hash join over a shuffle at every size, of
texts rather than of their tokens, which are several times as large.
"""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

BUCKETS, THRESHOLD = 1 << 14, -0.4
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it and wherever Spark moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of_text() -> Column:
    return F.array_remove(F.split(_text(), f"[{SPACE}]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more, the first included.

    words must be a plain column or bound by let. Windows are told apart by a 64-bit hash of their words.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    hashes = F.transform(at, window)
    places = F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))

    covered = F.aggregate(
        F.flatten(F.transform(F.array(places), twice)),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) < 4, 0).when(F.size(F.array_distinct(hashes)) == F.size(words) - 2, 0).otherwise(covered)


def base(docs: DataFrame) -> DataFrame:
    """docs with `_q_*` columns: the words, the base counts and the base verdict."""
    text = _text()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.withColumn("_q_words", words_of_text()).withColumn("_q_lines", lines)
    words = F.col("_q_words")
    df = df.withColumns(
        {
            "_q_n_words": F.size(words).cast("long"),
            "_q_word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "_q_n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_repeat_words": repeated_words(words).cast("long"),
        }
    )
    return df.withColumn("_q_base_failed", fails(F.col("_q_n_words"), F.col("_q_n_repeat_words")))


def fails(words: Column, repeated: Column) -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (words < MIN_WORDS) | (100 * repeated.cast("long") > MAX_REPEATED_PERCENT * words)


def cells(tokens: Column) -> Column:
    """Cells of the tokens and of pairs of neighbours; tokens must be a plain column or bound by let."""
    cell = lambda *t: F.pmod(F.xxhash64(*t), F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: cell(tokens[i], tokens[i + 1]))
    return F.concat(F.transform(tokens, lambda t: cell(t)), F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<int>")))


def tokens() -> Column:
    return F.regexp_extract_all(_text(), F.lit(TOKEN), F.lit(0))


def cell_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, n, good): how often each cell occurs in all documents, and in trusted ones."""
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_q_id"), F.lit(1).alias("_q_good")).distinct()
    told = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_q_id"), "left")
    grams = told.select("_q_good", tokens().alias("_q_tokens"))
    grams = grams.select(F.coalesce("_q_good", F.lit(0)).alias("good"), F.explode(cells(F.col("_q_tokens"))).alias("cell"))
    return grams.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of trusted to raw probability per cell, with one added to every count; zeros if nothing is trusted."""
    counts = np.zeros((2, BUCKETS))
    for cell, n, good in cell_counts(docs, labels).collect():
        counts[:, cell] = n, good
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw, target = np.log(counts + 1) - np.log(counts.sum(1, keepdims=True) + BUCKETS)
    return target - raw


def mean_ratio(held: Column, ratios: Column) -> Column:
    """Mean log ratio over the cells of a text; 0 without cells."""
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda acc, c: acc + F.get(ratios, c)) / F.size(held)).otherwise(0.0)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the base columns, `_q_score` and `_q_kept`.

    Null and empty texts have no words, score 0 and fail the base rules. Repeated rows
    get the same verdict each. Whole texts count, however long; a score equal to the
    threshold is kept; an empty table gives no rows. Columns of docs pass through, but for
    those whose names begin with _q_, which are overwritten.
    """
    ratios = F.lit(log_ratios(docs, labels))
    df = base(docs).withColumn("_q_tokens", tokens()).withColumn("_q_cells", cells(F.col("_q_tokens")))
    return df.withColumn("_q_score", mean_ratio(F.col("_q_cells"), ratios)).withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_score") >= F.lit(float(threshold))))


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judged(docs.select("doc_id", "text"), labels, threshold).select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the base rules or the score reject.

    Null and empty texts are rejected; repeated rows stay or go together; without trusted
    documents the base rules decide alone. Columns of any name pass through unchanged.
    """
    ratios = F.lit(log_ratios(docs, labels))
    good = ~let(words_of_text(), lambda w: fails(F.size(w), repeated_words(w)))
    likely = let(tokens(), lambda t: let(cells(t), lambda c: mean_ratio(c, ratios))) >= F.lit(float(threshold))
    return docs.filter(good & likely)
