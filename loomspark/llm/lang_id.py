"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores.

Document frequencies come from every learnable document; the classifier is fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of each language, and a temperature fitted on examples held back from it
turns its scores into probabilities.

A document is rejected if it has no letter, if even its likeliest language is hardly likelier than chance, or if its
n-grams are too rare for that language: their mean inverse document frequency is a number of standard deviations above
that of the language's examples, more being allowed for short texts, whose mean varies more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import sampled, tune
from loomspark.llm.ftrl import Ftrl, logits, probabilities, temperature

#: Hashed features (2 to this power), n-gram lengths 1 to ORDER, and code points hashed at a time.
BITS, ORDER, STEP = 15, 3, 1 << 19
#: At most about this many labelled documents of each language are learned from; passes over them.
PER_LANGUAGE, EPOCHS = 600, 3
#: Calibrated probability below which a long text's language counts as not identified; n-grams at which half of the way from chance to it is required.
UNKNOWN, LEAST, HALFWAY = "und", 0.4, 300
#: Standard deviations of the mean rarity of n-grams above which a text is in no learned language; neighbouring n-grams that vary as one; examples that the deviation within a language's documents is known from at least.
FOREIGN, TIED, KNOWN = 7.0, 6, 20

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a lower-cased text, and how often each occurs; long texts are hashed in pieces."""
    total = None
    text = text.lower()
    for at in range(0, max(1, len(text)), STEP):
        part = text[max(0, at - ORDER + 1) : at + STEP]  # n-grams across the cut, each counted once
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        skip, hashed, h = min(at, ORDER - 1), [], np.zeros(len(code), np.uint64)
        for n in range(1, ORDER + 1):
            if len(code) < n:
                break
            h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            hashed.append((h[max(0, skip - n + 1) :] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
        counts = np.bincount(np.concatenate(hashed).astype(np.int64) if hashed else np.zeros(0, np.int64), minlength=1 << BITS)
        total = counts if total is None else total + counts
    index = np.flatnonzero(total)
    return index, total[index]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    """Weights, inverse document frequencies, language names by output, and the temperature."""

    weights: np.ndarray
    idf: np.ndarray
    languages: list[str]
    heat: float
    #: By language: mean rarity of its examples, variance between them, and variance of n-grams within one.
    rarities: np.ndarray

    def scores(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        if len(self.languages) == 1:
            return np.ones(1)
        return probabilities(logits(self.weights, *weighted(index, counts, self.idf)) / self.heat)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 if there is no letter or nothing was learned."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.scores(*grams(text))
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])

    def accepts(self, text: str | None, least: float = LEAST, foreign: float = FOREIGN) -> bool:
        """Whether the text is in a learned language, as far as its length allows to say."""
        if not text or not self.languages or not has_letter(text):
            return False
        index, counts = grams(text)
        p = self.scores(index, counts)
        k, n, chance = int(np.argmax(p)), int(counts.sum()), 1 / len(self.languages)
        if p[k] < chance + max(0.0, least - chance) * n / (n + HALFWAY):
            return False
        mean, between, within = self.rarities[k]
        return bool(counts @ self.idf[index] / n <= mean + foreign * np.sqrt(between + TIED * within / n))


def weighted(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear TF-IDF of unit length."""
    value = np.log1p(counts) * idf[index]
    return index, value / (np.linalg.norm(value) or 1.0)


def _rarities(examples: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, languages: int) -> np.ndarray:
    """``mean, variance between, variance within`` by language, those of all examples where a language has few."""
    rows = []
    for index, counts, y in examples:
        n = counts.sum()
        mean = counts @ idf[index] / n
        rows.append((y, mean, counts @ (idf[index] - mean) ** 2 / n))
    y, mean, within = np.array(rows).T if rows else np.zeros((3, 0))
    out = []
    for k in range(languages):
        own = y == k if (y == k).sum() >= KNOWN else np.ones(len(y), bool)
        out.append((mean[own].mean(), mean[own].var(), within[own].mean()) if own.any() else (np.inf, 0.0, 0.0))
    return np.array(out).reshape(-1, 3)


def fit(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that ``learnable`` marks and that have a language and a text.

    Frequencies cover all these rows.  The classifier's sample holds about ``per_language`` rows of each language,
    chosen by a hash of the id and the text, repeated rows once, so the driver gets about that many sparse vectors of at
    most 2^BITS entries for each language.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).selectExpr("cast(doc_id as long) doc_id", "text", "cast(lang as string) lang")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[grams(text)[0]] += 1
                n += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(seen[index], n))], names=["feature", "df"])

    found = rows.select("text").mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # 2^BITS + 1 rows at most
    df = np.zeros((1 << BITS) + 1)
    for r in found:
        df[r.feature] = r.df
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model(np.zeros(((1 << BITS) + 1, 1)), idf, [], 1.0, np.zeros((0, 3)))
    chosen = F.lit(False)
    for lang in languages:
        chosen = chosen | ((F.col("lang") == lang) & sampled(4, per_language / counts[lang], "doc_id", "text"))
    # A repeated row is chosen with all its copies: they are merged where they are read, before the exchange.
    sample = rows.where(chosen).groupBy("doc_id", "lang", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("doc_id", "text", "lang")

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [grams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.tolist() for i, _ in pairs], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in pairs], pa.list_(pa.int32()))], names=["doc_id", "lang", "i", "c"])

    got = sample.mapInArrow(vectors, "doc_id long, lang string, i array<int>, c array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    examples = [(np.asarray(i.values), np.asarray(c.values), languages.index(lang)) for lang, i, c in zip(got["lang"].to_pylist(), got["i"], got["c"]) if len(i)]
    rarities = _rarities(examples, idf, len(languages))
    if len(languages) == 1:
        return Model(np.zeros(((1 << BITS) + 1, 1)), idf, languages, 1.0, rarities)
    vectors_of = lambda back: [(*weighted(i, c, idf), y) for k, (i, c, y) in enumerate(examples) if (k % 5 == 4) is back]
    weights = Ftrl(1 << BITS, len(languages)).fit(vectors_of(False), epochs)
    back = vectors_of(True)
    heat = temperature(np.array([logits(weights, i, v) for i, v, _ in back]), np.array([y for _, _, y in back], int))
    return Model(weights, idf, languages, heat, rarities)


def held_out() -> Column:
    """True for documents that are never learned from: the CRC-32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learnable() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))


def predictor(docs: DataFrame, model: Model) -> Broadcast:
    """The model as a broadcast variable: its size is 2^BITS times the number of languages, whatever the input."""
    return docs.sparkSession.sparkContext.broadcast(model)


def lang_id(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The language of every text: ``doc_id, held_out, lang_pred, score``.

    Learns from ``train`` (default: ``docs``), held-out ids excluded; rows with a null id are neither held out nor
    learned from.  A null text or one without a letter is ``und`` with score 0, as is everything when no row has a
    language; ties go to the language first in the alphabet.  Repeated rows give repeated rows, an empty table none;
    columns other than doc_id, text and lang are not read.  A very long text is hashed in pieces of STEP code points, so
    it takes little more memory than itself.
    """
    model = predictor(docs, fit(docs if train is None else train, learnable()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            said = [m.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, train: DataFrame, least: float = LEAST, foreign: float = FOREIGN) -> DataFrame:
    """The rows of ``docs`` in a language learned from ``train``, all columns as they are.

    Rows go whose text is null, has no letter, is not identified with a probability of ``least`` (less for short texts,
    down to chance), or consists of n-grams too rare for its language by ``foreign`` standard deviations; without any
    labelled row all go.  Repeated rows are judged alike; an empty table gives none.
    """
    model = predictor(docs, fit(train, learnable()))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield batch.filter(pa.array([m.accepts(t, least, foreign) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
