"""Language identification: words first, then ever shorter character n-grams.

Fitting counts the lower-cased words of a sample of labelled documents and the
character n-grams of those words (with a mark at both ends), for each language.
A known word scores by its log frequency in each language. An unseen word falls
back to its n-grams of ``longest`` characters, scoring by the mean of those
known; if none is known to shorter ones, down to single characters.

The sample takes about ``sample_docs`` documents of each language, by a hash of
the id, and the model keeps the ``top_words`` commonest words and ``top_grams``
commonest n-grams of each, so the model that goes to all tasks has a fixed bound.
Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if nothing was learned; equal scores go to the first language by
name; a null ``doc_id`` is neither learned from nor held out; repeated rows each
get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
MEMO_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 3000  # of each language, about
    top_words: int = 30_000  # of each language
    top_grams: int = 40_000  # of each language
    longest: int = 4
    smoothing: float = 0.5
    evidence_words: int = 20  # a text's score counts as that of so many words at most


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.string()), ("count", pa.int64())])


def counts(sample: DataFrame, longest: int) -> DataFrame:
    """(lang, n, item, count): n is 0 for words, else the n-gram's length. Counted in the
    task first, a part of the batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in common.rows_of(batch, "text", "lang"):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():
                items: Counter = Counter()
                for word, c in found.items():
                    items[0, word] += c
                    for n in range(1, longest + 1):
                        for gram in grams_of(word, n):
                            items[n, gram] += c
                rows = [(lang, n, item, c) for (n, item), c in items.items()]
                yield common.batch_of(COUNT_SCHEMA, [list(c) for c in zip(*rows)] or [[]] * 4)

    found = sample.mapInArrow(run, "lang string, n int, item string, count long")
    return found.groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))


@dataclass
class Model:
    """Languages and, for words (0) and each n, item -> log frequency by language."""

    langs: list[str]
    tables: list[dict[str, np.ndarray]]
    evidence_words: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, str, int]], settings: Settings) -> Model:
        langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(langs)}
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(settings.longest + 1)]
        for lang, n, item, count in rows:
            tables[n].setdefault(item, np.zeros(len(langs)))[at[lang]] = count
        for table in tables:
            total = sum(table.values(), np.zeros(len(langs))) + settings.smoothing * len(table)
            for item, c in table.items():
                table[item] = np.log((c + settings.smoothing) / total)
        return cls(langs, tables, settings.evidence_words)

    def word_scores(self, word: str) -> np.ndarray:
        """Log score of one word by language."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(len(self.tables) - 1, 0, -1):
            found = [g for g in map(self.tables[n].get, grams_of(word, n)) if g is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))

    def predictor(self):
        """text -> (language, score); remembers the words it has met."""
        rows: dict[str, int] = {}
        scores = np.zeros((1024, len(self.langs)))

        def predict(text: str | None) -> tuple[str, float]:
            nonlocal scores
            found = Counter(words_of(text))
            if not self.langs or not any(c.isalpha() for w in found for c in w[:8]) and not any(c.isalpha() for w in found for c in w):
                return UNKNOWN, 0.0
            if len(rows) + len(found) > MEMO_WORDS:
                rows.clear()
            at = []
            for word in found:
                k = rows.get(word)
                if k is None:
                    k = rows[word] = len(rows)
                    if k >= len(scores):
                        scores = np.concatenate((scores, np.zeros_like(scores)))
                    scores[k] = self.word_scores(word)
                at.append(k)
            times = np.fromiter(found.values(), np.float64, len(found))
            total = times @ scores[at]
            total *= min(1.0, self.evidence_words / times.sum())
            best = int(total.argmax())
            return self.langs[best], 1.0 / float(np.exp(total - total[best]).sum())

        return predict


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of ``labelled`` (doc_id, text, lang), learned from a bounded sample."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(settings.sample_docs / n))]) if sizes else None
    if share is None:
        return Model([], [{} for _ in range(settings.longest + 1)], settings.evidence_words)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    found = counts(rows.where(place < share[F.col("lang")]).select("text", "lang"), settings.longest)
    rank = F.row_number().over(Window.partitionBy("lang", F.col("n") > 0).orderBy(F.desc("count"), "n", "item"))
    limit = F.when(F.col("n") == 0, settings.top_words).otherwise(settings.top_grams)
    most = max(settings.top_words, settings.top_grams)
    top = found.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") <= limit)
    return Model.of([tuple(r) for r in top.select("lang", "n", "item", "count").collect()], settings)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = model.predictor()
        for batch in batches:
            out = [guess(t) for t in batch.column("text").to_pylist()]
            yield common.batch_of(SCHEMA, [batch.column("doc_id"), *([list(c) for c in zip(*out)] or [[]] * 2)])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's query: learn from three quarters of the ids, predict all."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = common.pick(docs, doc_id="long", text="string", lang="string")
    model = fit(rows.where(fold != 2), settings)
    return predict(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
