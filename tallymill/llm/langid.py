"""Language identification: known words first, shorter and shorter character n-grams for the others.

A model holds per language the log frequency of words and of n-grams of one to five characters. A word that
some language knows is scored by its word frequencies; any other by the mean over its longest n-grams that
some language knows. A text's language is the one with the best mean over its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import kept, stored, strings, text_udf
from tallymill.plans.ordered import first_rows

#: Bounds of the model. Per language it learns from about SAMPLE_DOCS documents chosen by a hash of their id,
#: and keeps the most frequent words and n-grams within these totals for all languages.
SAMPLE_DOCS = 10_000
MODEL_WORDS = 160_000
MODEL_GRAMS = 120_000
LONGEST_GRAM = 5
#: Log10 frequency of what a language has never seen.
UNSEEN = -7.0
#: Values of unseen words' scores a worker keeps before it starts anew; steers cost only.
REMEMBERED = 2_000_000
TEXTS_AT_ONCE = 64
#: Shares into which the tokens of a language are dealt to find the most frequent; steers cost only.
SALTS = 32
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def _letters_only(counts: Counter) -> Counter:
    """The same counts with all but letters cut out of the words. Signs such as a half or a squared are numbers, not
    letters, though patterns count them as word characters."""
    for mixed in [w for w in counts if not w.isalpha()]:
        n = counts.pop(mixed)
        for word in _LETTERS.findall(mixed):
            counts[word] += n
    return counts


def _words(text: str) -> Counter:
    """The words of a text in lower case, with their counts: runs of letters."""
    return _letters_only(Counter(_WORD.findall(text.lower())))


def _shares(scores: np.ndarray) -> np.ndarray:
    shares = 10.0 ** (scores - scores.max(axis=1, keepdims=True, initial=UNSEEN))  # no language, no scores
    return shares / shares.sum(axis=1, keepdims=True)


class Model:
    """Log10 frequencies, one row per entry and one column per language.

    Every word met gets a line of scores and of shares (how much it speaks for each language) once; texts add up lines.
    """

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table
        self._forget()

    def _forget(self) -> None:
        """Lines of the known words alone."""
        self._line = {word: line for line, word in enumerate(self.words)}
        self._scores = self.table[np.array(list(self.words.values()), np.int64)].astype(np.float64)
        self._shares = _shares(self._scores)

    def __getstate__(self) -> tuple:
        return self.languages, self.words, self.grams, self.table

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words no language knows: the longest n-grams that one knows, on average."""
        row_of = self.grams.get
        rows, sizes = [], []
        for word in words:
            padded, found = f" {word} ", []
            for size in range(min(LONGEST_GRAM, len(padded)), 0, -1):
                found = [r for r in map(row_of, [padded[i:i + size] for i in range(len(padded) - size + 1)]) if r is not None]
                if found:
                    break
            rows += found
            sizes.append(len(found))
        counts = np.array(sizes)
        scores = np.full((len(words), len(self.languages)), UNSEEN)
        if rows:
            starts = (np.cumsum(counts) - counts)[counts > 0]
            scores[counts > 0] = np.add.reduceat(self.table[rows].astype(np.float64), starts, axis=0) / counts[counts > 0, None]
        return scores

    def _meet(self, words: list[str]) -> None:
        begin, size = len(self._line), len(self._line) + len(words)
        if size > len(self._scores):
            grown = max(size, 2 * len(self._scores)) - begin
            self._scores, self._shares = (np.concatenate((t[:begin], np.empty((grown, t.shape[1])))) for t in (self._scores, self._shares))
        self._scores[begin:size] = self._unseen(words)
        self._shares[begin:size] = _shares(self._scores[begin:size])
        self._line.update(zip(words, range(begin, size)))

    def predict(self, text: str) -> tuple[str, float]:
        """Language and a score of 0 to 1: how much of the text's words speak for it."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """``predict`` for every text; words new to the model are scored together."""
        counted = [_words(text) for text in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if (len(self._line) - len(self.words)) * len(self.languages) > REMEMBERED:
            self._forget()
        self._meet(list(set().union(*counted).difference(self._line)))
        found = []
        for counts in counted:
            if not counts:
                found.append((UNKNOWN, 0.0))
                continue
            lines = list(map(self._line.__getitem__, counts))
            weight = np.fromiter(counts.values(), np.float64, len(counts))
            best = int(np.argmax(weight @ self._scores[lines]))
            found.append((self.languages[best], min(1.0, float(weight @ self._shares[lines, best] / weight.sum()))))
        return found


def _lang_table(counts: dict[str, Counter]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang for lang, own in counts.items() for _ in own], pa.string()), pa.array([w for own in counts.values() for w in own], pa.string()),
                                       pa.array([n for own in counts.values() for n in own.values()], pa.int64())], ["lang", "token", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("langid")  # makes room
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
            counts.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        yield _lang_table({lang: _letters_only(own) for lang, own in counts.items()})


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike: dict[tuple, list] = {}  # most words are rare: equal counts are multiplied once per n-gram
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "token", "n"))):
            alike.setdefault((lang, n), []).append(f" {word} ")
        counts: dict[str, defaultdict] = {}
        for (lang, n), words in alike.items():
            own = counts.setdefault(lang, defaultdict(int))
            for gram, k in Counter([w[i:i + size] for w in words for size in range(1, LONGEST_GRAM + 1) for i in range(len(w) - size + 1)]).items():
                own[gram] += n * k
        yield _lang_table(counts)


def _most_frequent(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent tokens of every key, in two levels: a language may hold most of all tokens."""
    order = [F.desc("n"), F.asc("token")]
    shares = first_rows(counts.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS))), [*by, "salt"], order, k)
    return first_rows(shares, by, order, k).drop("salt")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame) -> Model:
    """A model from (doc_id, lang, text). Rows with a null in any of them teach nothing."""
    usable = labelled.filter("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = stored(chosen.select("lang", "text").mapInArrow(_word_counts, "lang string, token string, n bigint")
                   .groupBy("lang", "token").agg(F.sum("n").alias("n")), "words")
    grams = stored(words.mapInArrow(_gram_counts, "lang string, token string, n bigint").withColumn("size", F.length("token"))
                   .groupBy("lang", "size", "token").agg(F.sum("n").alias("n")), "grams")
    per_word, per_gram = MODEL_WORDS // len(languages), MODEL_GRAMS // (len(languages) * LONGEST_GRAM)
    common = _most_frequent(words, ["lang"], per_word)
    parts = _most_frequent(grams, ["lang", "size"], per_gram)
    word_total = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_total = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    column = {lang: i for i, lang in enumerate(languages)}
    word_rows, gram_rows, entries = {}, {}, []
    for r in common.collect():
        row = word_rows.setdefault(r["token"], len(word_rows))
        entries.append((row, column[r["lang"]], np.log10(r["n"] / word_total[r["lang"]])))
    for r in parts.collect():
        row = gram_rows.setdefault(r["token"], len(word_rows) + len(gram_rows))
        entries.append((row, column[r["lang"]], np.log10(r["n"] / gram_total[r["lang"], r["size"]])))
    table = np.full((len(word_rows) + len(gram_rows), len(languages)), UNSEEN, np.float32)
    for row, at, value in entries:
        table[row, at] = value
    return Model(languages, word_rows, gram_rows, table)


def predictions(texts: DataFrame, model: Model, text: str = "text", name: str = "_lang") -> DataFrame:
    """All columns of ``texts`` plus ``name``: a struct of lang and score, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text when there was nothing
    to learn from. Row-local; equal texts get equal answers, and an equal score goes to the language
    first in the alphabet. An input column called ``name`` is replaced.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.Array) -> pa.Array:
        kept("langid")  # makes room
        found = []
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            found += shared.value.predict_all(strings(batch.slice(at, TEXTS_AT_ONCE)))
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return texts.withColumn(name, text_udf(run, "struct<lang:string,score:double>")(F.col(text)))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document, learnt from the documents not held out."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    return predictions(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))
