"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Iterative quantisation learns rotations on a bounded sample; the signs of the rotated, centred components form the code.
A code is cut into substrings of 16 bits, each with its own table: the rows of every value, by a directory of all 65,536.
Of m substrings, codes within a radius R = m r + a of a query agree with it within r bits in one of the first a + 1, or
within r - 1 bits in one of the others (pigeonhole), so probing those balls in all tables retrieves every code within R;
the retrieved are verified over the whole code, and those within R reranked by the original floats.

The radius is the one that holds nearly all true neighbours of a few pilot rows, which are searched exactly among all
rows, so it narrows as the table grows.  Queries that still find fewer than k candidates are searched again with the
radius of the whole code, so none comes back short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._tables import sampled, stash

#: Vectors to learn from at most (about), pilot rows (about), bits of a code at least, rounds of quantisation, share of the pilots' neighbours inside the radius.
SAMPLE, PILOTS, BITS, ROUNDS, INSIDE = 8192, 64, 64, 20, 0.97
#: Bytes of the queries sent to the tasks at a time (about), and of the rows of a block of tables.
QUERIES, BLOCK = 64 << 20, 32 << 20
#: Rows of an Arrow batch, and results yielded at a time.
ROWS, YIELD = 8192, 1024
WORD = 16

SCHEMA = "query_id long, vec_id long, score double, bits int"


@dataclass
class Codec:
    """Centre and stacked rotations; codes are rows of 16-bit substrings."""

    centre: np.ndarray
    turn: np.ndarray

    @property
    def words(self) -> int:
        return self.turn.shape[1] // WORD

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1).view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of ``a`` from each row of ``b``."""
    total = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        total += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return total


def learn(sample: np.ndarray, seed: int = 10) -> Codec:
    """Rotations by iterative quantisation, as many as make up BITS; the code has a whole number of substrings."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    x, width = sample - centre, sample.shape[1]
    turns = []
    for _ in range(ceil(BITS / width)):
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        turns.append(r)
    turn = np.hstack(turns)
    return Codec(centre, turn[:, : turn.shape[1] // WORD * WORD])


@lru_cache(WORD + 1)
def ball(radius: int) -> np.ndarray:
    """All substrings with at most so many bits."""
    every = np.arange(1 << WORD, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class Tables:
    """The codes of a block of vectors, each substring indexed by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.order = self.codes.argsort(0, kind="stable")
        # Rows of a value v in table j: order[start[j][v] : start[j][v + 1], j].
        self.start = [np.concatenate(([0], np.bincount(self.codes[:, j], minlength=1 << WORD).cumsum())) for j in range(self.codes.shape[1])]

    def probed(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The rows, ascending, that the balls of the pigeonhole principle retrieve."""
        r, a = divmod(radius, len(query))
        hit = np.zeros(len(self.codes), bool)
        for j, value in enumerate(query):
            small = r if j <= a else r - 1
            if small < 0:
                continue
            values = value ^ ball(min(small, WORD))
            low, size = self.start[j][values], self.start[j][values.astype(np.int64) + 1]
            size = size - low
            low, size = low[size > 0], size[size > 0]
            if len(low):  # the ranges low .. low + size, one after the other
                skip = np.concatenate(([0], size[:-1].cumsum()))
                hit[self.order[np.repeat(low - skip, size) + np.arange(size.sum()), j]] = True
        return np.flatnonzero(hit)

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all codes within the radius, and their distances in bits."""
        rows = self.probed(query, radius)
        bits = distances(query[None], self.codes[rows])[0]
        return rows[bits <= radius], bits[bits <= radius]


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite components, not all of them zero."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & (F.size(v) == size if size else F.lit(True)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _scan(rows: DataFrame, codec: Codec, ids: np.ndarray, queries: np.ndarray, radius: int, k: int) -> DataFrame:
    """For every query the k nearest of each block of rows among the codes within the radius."""
    sent = rows.sparkSession.sparkContext.broadcast((codec, ids, queries))

    def searched(names: np.ndarray, x: np.ndarray, codec: Codec, ids: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        tables = Tables(codec.encode(x))
        out: list[tuple[np.ndarray, ...]] = []
        for i, code in enumerate(codes):
            found, bits = tables.within(code, radius)
            other = names[found] != ids[i]
            found, bits = found[other], bits[other]
            if len(found):
                d, who = np.sqrt(((x[found] - queries[i]) ** 2).sum(1)), names[found]
                if len(d) > 4 * k:  # all that ties with the k-th stays for the sort
                    near = d <= np.partition(d, k - 1)[k - 1]
                    d, who, bits = d[near], who[near], bits[near]
                top = np.lexsort((who, d))[:k]
                out.append((np.full(len(top), ids[i]), who[top], d[top], bits[top].astype(np.int32)))
            if len(out) >= YIELD or out and i + 1 == len(codes):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score", "bits"])
                out = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ids, queries = sent.value
        codes, width = codec.encode(queries), queries.shape[1]
        names: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            yield from searched(np.concatenate(names), np.concatenate(vectors), codec, ids, queries, codes)
            names.clear()
            vectors.clear()

        for batch in batches:
            names.append(np.asarray(batch.column(0)))
            vectors.append(_matrix(batch.column(1), width))
            if sum(map(len, names)) * width * 8 >= BLOCK:
                yield from block()
        if names:
            yield from block()

    return rows.mapInArrow(run, SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """The k nearest other rows of every query row by Euclidean distance: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on vec_id.  Rows without an id, and vectors that are null, zero or hold null or
    non-finite components, take no part; neither do vectors of another length than most, which have no distance.  Where
    an id has several vectors the smallest stands for it, so repeated rows count once.  Ties go to the smaller vec_id.
    With fewer than k other rows, all are returned; an empty table gives no rows.  Other columns are not read.

    The sample, the pilots and the queries of one pass (QUERIES bytes) come to the driver and go to the tasks; a task
    holds one block of rows (BLOCK bytes) with its tables.  All rows are passed once for the pilots, and once for as many
    queries as fit in QUERIES bytes.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = usable(vectors).groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        return none
    width, n = common[0]["size"], common[0]["ids"]
    rows = usable(vectors, width)
    if common[0]["n"] > n:
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    of = lambda table: (np.asarray(table["vec_id"].combine_chunks()), _matrix(table["v"].combine_chunks(), width))
    asked = rows.where(is_query)
    blocks = max(1, ceil(asked.count() * width * 8 / QUERIES))
    learned = of(rows.where(sampled(1, sample / n, "vec_id")).toArrow().sort_by("vec_id"))[1]
    if not len(learned):  # a sample of very few rows may be empty
        learned = np.zeros((1, width))
    codec = learn(learned)
    radius = every = WORD * codec.words
    pilots = of(rows.where(sampled(3, PILOTS / n, "vec_id")).toArrow().sort_by("vec_id"))
    if len(pilots[0]):
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = _scan(rows, codec, *pilots, every, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        bits = np.asarray(found.select("bits").toArrow()["bits"].combine_chunks())  # k for each pilot
        radius = int(np.ceil(np.quantile(bits, INSIDE))) if len(bits) else every
    out = none
    for b in range(blocks):
        ids, x = of(asked.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)) == b).toArrow().sort_by("vec_id"))
        if not len(ids):
            continue
        found, _ = stash(_ranked(_scan(rows, codec, ids, x, radius, k), k), "nearest")
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select("query_id").toArrow()  # at most a block's ids
        short = ~np.isin(ids, np.asarray(full["query_id"].combine_chunks()))
        if short.any():
            more, _ = stash(_ranked(_scan(rows, codec, ids[short], x[short], every, k), k), "nearest")
            found = found.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids[short]], "query_id long")), "query_id", "left_anti").unionByName(more)
        out = found if out is none else out.unionByName(found)
    return out
