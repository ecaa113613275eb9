"""Language identification by words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. A word that the model
does not know falls back to its character n-grams (with word ends): to the longest
length of which it has any known n-gram, the mean of their log frequencies.

Words are runs of letters with the marks that go with them; numerals are no letters.
Counts cover every training document. The model keeps the most frequent words and
n-grams of every language, a fixed number for all languages together, so its size
does not depend on the corpus; what is kept has its true counts in all languages.
Count thresholds per language come from histograms of counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, bounded_arrow, cut

#: Most words and most n-grams in the model, and the longest n-gram.
WORDS, GRAMS, LONGEST = 160_000, 240_000, 4
#: Word counts that a task holds before it hands them on; scores (one for each language of a word) that a worker remembers.
HELD, REMEMBERED = 100_000, 1_000_000
#: A table of at most so many words times languages is laid out in full, for speed; a larger one holds what languages have.
CELLS = 4_000_000
SMOOTH = 0.5
UNKNOWN = "und"
#: Texts without code points from here on need only the letters before it.
LATIN = 0x300


def _class(kinds: str, end: int) -> str:
    """A character class of the code points below end whose Unicode category begins with one of kinds."""
    ranges: list[list[int]] = []
    for c in range(end):
        if unicodedata.category(chr(c))[0] in kinds:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _finder() -> Callable[[str], list[str]]:
    latin = re.compile(f"[{_class('L', LATIN)}]+").findall
    every = re.compile(f"[{_class('L', sys.maxunicode + 1)}][{_class('LM', sys.maxunicode + 1)}]*").findall
    beyond = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]").search
    return lambda text: every(text) if not text.isascii() and beyond(text) else latin(text)


_find: Callable[[str], list[str]] | None = None


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text."""
    global _find
    _find = _find or _finder()
    return _find(text.lower()) if text else []


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves `part`; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all docs (lang, text); words are lower-case runs of letters."""
    bounded_arrow(docs.sparkSession)

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for langs, texts in as_rows(batches, "lang", "text"):
            for lang, text in zip(langs, texts):
                counts[lang].update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield from given(counts)
                counts.clear()
        yield from given(counts)

    def given(counts):
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", F.col("text")).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, word, n) of the n-grams of counted words; ^ and $ stand for the ends of a word."""
    w = words.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.char_length("w") - k + 1), lambda i: F.substring(F.col("w"), i, F.lit(k)))
    grams = F.concat(*[F.when(F.char_length("w") >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, LONGEST + 1)])
    return w.select("lang", "n", F.explode(grams).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, list[str], list[int]]]:
    """(word, langs, counts) of the words among the most frequent of some language, with their counts in all languages.

    Every language brings an equal part of `most`; of equal counts at its limit all or none.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    by_lang: dict[str, list] = defaultdict(list)
    for lang, at, rows in histogram:
        by_lang[lang].append((at, rows))
    kept = []
    for lang, levels in by_lang.items():
        room, least = most // len(by_lang), None
        for at, rows in sorted(levels, reverse=True):
            room -= rows
            if room < 0:
                break
            least = at
        if least is not None:
            kept.append((lang, least))
    if not kept:
        return []
    floors = counts.sparkSession.createDataFrame(kept, "lang string, least int")
    marked = counts.join(F.broadcast(floors), "lang", "left").withColumn("kept", F.coalesce(level >= F.col("least"), F.lit(False)))
    found = marked.groupBy("word").agg(F.max("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("of")).filter("kept")
    rows = found.select("word", "of.lang", "of.n").toArrow().to_pydict()
    return list(zip(*rows.values()))


class LanguageModel:
    """Log frequencies of words and n-grams, for the languages that have them."""

    def __init__(self, words: list[tuple], grams: list[tuple], documents: dict[str, int]):
        self.langs = sorted(documents)
        self.prior = np.log(np.array([documents[x] for x in self.langs], float)) if documents else np.zeros(0)
        self.words = self._table(words)
        self.grams = self._table(grams)

    def _table(self, rows: list[tuple]) -> tuple:
        """(place by word, ends, languages, log frequencies, log frequency of what a language lacks, all of them as a matrix if it is small)."""
        lang = {x: i for i, x in enumerate(self.langs)}
        ends = np.cumsum([0, *[len(langs) for _, langs, _ in rows]]).astype(np.int32)
        which = np.array([lang[x] for _, langs, _ in rows for x in langs], np.int32)
        counts = np.array([n for _, _, ns in rows for n in ns], float)
        total = np.log(np.maximum(np.bincount(which, counts, len(lang)) + SMOOTH * len(rows), SMOOTH)) if lang else np.zeros(0)
        logs, none = (np.log(counts + SMOOTH) - total[which]).astype(np.float32), (np.log(SMOOTH) - total).astype(np.float32)
        full = None
        if len(rows) * len(lang) <= CELLS:
            full = np.tile(none, (len(rows), 1))
            full[np.repeat(np.arange(len(rows)), np.diff(ends)), which] = logs
        return {word: i for i, (word, _, _) in enumerate(rows)}, ends, which, logs, none, full

    @staticmethod
    def _mean(table: tuple, places: list[int]) -> np.ndarray:
        """Mean log frequencies per language of some rows of a table."""
        _, ends, which, logs, none, full = table
        if full is not None:
            return full[places[0]] if len(places) == 1 else full[places].mean(0)
        total = none * np.float32(len(places))
        for p in places:
            a, b = ends[p], ends[p + 1]
            total[which[a:b]] += logs[a:b] - none[which[a:b]]
        return total / np.float32(len(places))

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word per language, by words or else by the longest n-grams known."""
        if (found := self.words[0].get(word)) is not None:
            return self._mean(self.words, [found])
        place, word = self.grams[0], f"^{word}$"
        for k in range(LONGEST, 0, -1):
            known = [g for i in range(len(word) - k + 1) if (g := place.get(word[i : i + k])) is not None]
            if known:
                return self._mean(self.grams, known)
        return np.zeros(len(self.langs), np.float32)

    def judge(self, scores: np.ndarray, n: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Best language and its probability from summed scores of n words; temperature grows as the root of n."""
        if not self.langs:
            return [UNKNOWN] * len(n), np.zeros(len(n))
        x = (scores + self.prior) / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(x - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = (scores + self.prior).argmax(1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, p[np.arange(len(n)), best], 0.0)


def train(docs: DataFrame) -> LanguageModel:
    """A model from the rows with a language and a text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    words = cut(word_counts(known))
    documents = {lang: n for lang, n in known.groupBy("lang").count().collect()}
    return LanguageModel(most_frequent(words, WORDS), most_frequent(cut(gram_counts(words)), GRAMS), documents)


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row; `und` and 0 for a text that is null or has no letter."""
    bounded_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros((1024, len(m.langs)), np.float32)
        for ids, texts in as_rows(batches, "doc_id", "text"):
            lists = [words_of(t) for t in texts]
            n = np.array([len(x) for x in lists], np.int64)
            coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
            if len(known) * len(m.langs) > REMEMBERED:
                known.clear()
            words = coded.dictionary.to_pylist()
            for w in words:
                if w not in known:
                    if len(known) == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[len(known)] = m.word(w)
                    known[w] = len(known)
            place = np.array([known[w] for w in words], np.int64)[coded.indices.to_numpy()]
            sums = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(table[place], 0, dtype=np.float64)])
            ends = np.cumsum(n)
            langs, scores = m.judge(sums[ends] - sums[ends - n], n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; trained on the rows that are not held out.

    A row with a null id is neither held out nor learned from. Without any training
    row every prediction is `und`. Null texts and texts without a letter are `und`, with
    score 0. Whole texts count, however long; of languages with equal scores the first
    by name is taken. Repeated rows give repeated rows, an empty table none; other
    columns are ignored, whatever their names.
    """
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
