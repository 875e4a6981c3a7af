"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import sampled, tune
from loomspark.llm.ftrl import Ftrl, logits, probabilities

#: Hashed features (2 to this power); about how many labelled documents are learned from; least number of updates; score from which a document is good.
BITS, SAMPLE, UPDATES, GOOD = 18, 6000, 24_000, 0.3
#: Words and runs of marks, in UTF-8.
WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
#: The pair of a word and itself, whatever the word.
REPEAT = crc32(b"\0=")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word pairs with sublinear counts of unit length."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass"))
    one = [crc32(w) for w in words]
    two = [crc32(w, h) if w != v else REPEAT for h, v, w in zip(one, words, words[1:])]
    index, counts = np.unique(np.array(one + two, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS), return_counts=True)
    value = np.log1p(counts)
    return index.astype(np.int64), value / (np.linalg.norm(value) or 1.0)


def held_out() -> Column:
    """True for documents whose labels are never learned from: the CRC-32 of the id's text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE, updates: int = UPDATES) -> np.ndarray:
    """Weights learned from about ``sample`` labelled rows, chosen by a hash of the id, of those that ``learnable`` marks.

    The chosen labels (two integers each) are broadcast, and as many sparse vectors, of 2^BITS entries at most each, come
    to the driver: both are bounded by ``sample``.  Repeated rows of either table are learned from once.
    """
    known = labels.where(learnable & F.col("quality").isin(0, 1)).selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) y").distinct()
    n = known.count()
    chosen = known.where(sampled(8, sample / max(n, 1), "doc_id"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("doc_id", "text", "y")

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [ngrams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([i.tolist() for i, _ in pairs], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in pairs], pa.list_(pa.float64()))], names=["doc_id", "y", "i", "v"])

    got = rows.mapInArrow(vectors, "doc_id long, y int, i array<int>, v array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    examples = [(np.asarray(i.values).astype(np.int64), np.asarray(v.values), y) for y, i, v in zip(got["y"].to_pylist(), got["i"], got["v"])]
    return Ftrl(1 << BITS, 1).fit(examples, -(-updates // max(1, len(examples))))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every text: ``doc_id, held_out, score, predicted``.

    Learns from ``labels`` (doc_id, quality) outside the held-out ids; rows with a null id are neither held out nor
    learned from, and labels other than 0 and 1 are ignored.  A null or empty text scores by the bias alone, as does
    everything (0.5) without labels.  Repeated rows give repeated rows, an empty table none; other columns are not read.
    A very long text is one list of words and its distinct features at a time.  The weights broadcast to the tasks have a fixed size.
    """
    tune(docs.sparkSession)
    learnable = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learnable))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            scores = [float(probabilities(logits(w, *ngrams(t)))[0]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= GOOD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
