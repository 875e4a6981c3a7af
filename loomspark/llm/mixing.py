"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are dealt into blocks by a hash.  A source of weight w (weights are whole numbers or fractions,
w their share) gives its i-th block (from 1) the release time floor((i - 1) / w) and the deadline ceil(i / w), without
rounding; each time slot goes to the released block of the earliest deadline.  On one processor this meets all
deadlines, so at any slot a source has had less than one block more or fewer than its weight promises, until a source
runs out.  Slots in which no block is released, as sources have run out, are skipped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import stash
from loomspark.llm.sharding import hash_bits, text_bytes

#: Bytes of a block at most, blocks that the input makes at least (smaller inputs have smaller blocks), exponent of a source's bytes in its default weight.
BLOCK, SPREAD, ALPHA = 4 << 20, 512, 0.7
#: Blocks of a schedule (about 60 bytes each) up to which it is broadcast.
BROADCAST = 200_000

CELLS = "__t string, __i long, __slot long, __release long, __deadline long"

Cell = tuple[str | None, int, int, int, int]


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The same proportions as whole numbers, exactly."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("target weights must be positive and finite")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def by_size(n_bytes: int, alpha: float = ALPHA) -> int:
    """The default weight of a source: its bytes to the power ``alpha``, a whole number."""
    return int(max(1, n_bytes) ** alpha)


def schedule(weights: dict[str | None, float], blocks: dict[str | None, int]) -> Iterator[Cell]:
    """``(source, block, slot, release, deadline)`` of all blocks, by slot; memory for one block of each source.

    Ties of deadlines go to the source first in order, null before all.
    """
    names = sorted(blocks, key=lambda s: (s is not None, s))
    parts = whole({s: weights[s] for s in names})
    share = [parts[s] for s in names]
    total = sum(share)
    waiting = [(0, k, 0) for k in range(len(names)) if blocks[names[k]]]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // share[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        assert release <= slot < deadline
        yield names[k], i, slot, release, deadline
        if i + 1 < blocks[names[k]]:
            heapq.heappush(waiting, ((i + 1) * total // share[k], k, i + 1))
        slot += 1


def _cells(docs: DataFrame, weights: dict[str | None, float], blocks: dict[str | None, int]) -> DataFrame:
    """The schedule as a table, made by one task as a stream and written once: neither it nor the driver holds it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = schedule(weights, blocks) if batch.num_rows else iter(())
            while part := list(islice(cells, 10_000)):
                columns = list(zip(*part))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["__t", "__i", "__slot", "__release", "__deadline"])

    return stash(docs.sparkSession.range(1).coalesce(1).mapInArrow(run, CELLS), "schedule")[0]


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``__block, __slot, __release, __deadline``; see :func:`mixed`."""
    spark = docs.sparkSession
    totals = docs.groupBy(F.col("source").alias("s")).agg(F.sum(text_bytes()).alias("bytes")).collect()  # a row for each source
    if not totals:
        none = F.lit(None).cast("long")
        return docs.withColumns({f"__{c}": none for c in ("block", "slot", "release", "deadline")})
    missing = [r.s for r in totals if weights is not None and r.s not in weights]
    if missing:
        raise ValueError(f"no target weight for the sources {missing[:5]}")
    weights = {r.s: by_size(r.bytes, alpha) if weights is None else weights[r.s] for r in totals}
    block = block or min(BLOCK, max(1, -(-sum(r.bytes for r in totals) // SPREAD)))
    blocks = {r.s: max(1, -(-r.bytes // block)) for r in totals}
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "__s string, __n long"))
    dealt = docs.join(sizes, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__block", hash_bits() % F.col("__n"))
    # Beyond the bound both sides are shuffled by block, of which none is larger than a few documents beyond its size.
    cells = _cells(docs, weights, blocks)
    small = sum(blocks.values()) <= BROADCAST
    return dealt.join(F.broadcast(cells) if small else cells, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__block") == F.col("__i"))).drop("__s", "__n", "__t", "__i")


def order() -> list[Column]:
    """Columns by which interleaved rows are sorted."""
    return [F.col("__slot"), hash_bits()]


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """Where every document comes in the mixture: ``doc_id, source, block, slot, release, deadline``.

    Reading by slot gives the mixture.  ``weights`` are the targets by source (None for rows without one), met exactly;
    by default a source's is its bytes to the power ``alpha``, rounded down.  Every document is in one block of its
    source, chosen by a hash of the id (of the text, for rows without an id), about ``block`` bytes a block: by default
    BLOCK, or less where the input wouldn't make SPREAD blocks.  A document is never split, so a very long one makes its
    block larger; null texts have no bytes; repeated rows come together; an empty table gives no rows; other columns are
    not read.  One aggregate by source is collected (a row for each source); the schedule has a row for each block and is
    broadcast if they are few, else joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return interleave(rows, weights, block, alpha).selectExpr("doc_id", "source", "__block block", "__slot slot", "__release release", "__deadline deadline")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all rows and columns, in the order of the mixture: written, file after file and row after row.

    :func:`positions` finds that order again in what was written.
    """
    rows = interleave(docs, **how)
    return rows.repartitionByRange(*order()).sortWithinPartitions(*order()).select(*[F.col(f"`{c}`") for c in docs.columns])


def positions(docs: DataFrame) -> DataFrame:
    """``docs``, as read from one folder of files, with ``position``, the number of each row (from 0) by file and row.

    A frame that is not read from files is written to the shared folder first.  The table of files is broadcast: one
    row for each, counted before.
    """
    from pyspark.errors import AnalysisException

    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        docs = stash(docs, "placed")[0]
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = sorted((r.file, r.n) for r in placed.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n")).collect())  # a row for each file
    starts, at = [], 0
    for file, n in sizes:
        starts.append((file, at))
        at += n
    table = docs.sparkSession.createDataFrame(starts, "__name string, __start long")
    placed = placed.join(F.broadcast(table) if len(starts) <= BROADCAST else table, F.col("__file") == F.col("__name"))
    return placed.withColumn("position", F.col("__start") + F.col("__row")).drop("__file", "__row", "__name", "__start")


def sql(block: int = BLOCK, spread: int = SPREAD, alpha: float = ALPHA) -> str:
    """The same rows in DuckDB's SQL, for default weights."""
    return f"""
WITH RECURSIVE tot AS (SELECT source, sum(COALESCE(octet_length(encode(text)), 0))::BIGINT AS bytes FROM documents GROUP BY source),
size AS (SELECT least({block}, greatest(1, (sum(bytes) + {spread} - 1) // {spread}))::BIGINT AS block FROM tot),
w AS (SELECT source, floor(power(greatest(1, bytes)::DOUBLE, {alpha}::DOUBLE))::BIGINT AS w, greatest(1, (bytes + block - 1) // block)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM tot, size),
l AS (SELECT list(w ORDER BY k) AS w, list(n ORDER BY k) AS n, sum(w)::BIGINT AS t FROM w),
due AS (
  SELECT 0::BIGINT AS slot, w, n, t, list_transform(w, lambda x: 0::BIGINT) AS i, list_transform(w, lambda x: ((t + x - 1) // x)::BIGINT) AS d FROM l
  UNION ALL
  SELECT s, w, n, t, j, list_transform(range(1, len(w) + 1), lambda q: CASE WHEN j[q] < n[q] AND j[q] * t // w[q] <= s THEN (((j[q] + 1) * t + w[q] - 1) // w[q])::BIGINT ELSE 9000000000000000000 END)
  FROM (SELECT *, greatest(slot + 1, list_min(list_transform(range(1, len(w) + 1), lambda q: CASE WHEN j[q] < n[q] THEN (j[q] * t // w[q])::BIGINT ELSE 9000000000000000000 END))) AS s
    FROM (SELECT *, list_transform(range(1, len(w) + 1), lambda q: i[q] + (q = list_position(d, list_min(d)))::BIGINT) AS j FROM due)) WHERE j <> n),
cell AS (SELECT list_position(d, list_min(d)) AS k, i[list_position(d, list_min(d))] AS i, slot, list_min(d) AS deadline, t FROM due)
SELECT doc_id, d.source, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '~' || md5(text), '')), 1, 15))::BIGINT % n AS block, slot, i * t // w AS release, deadline
FROM documents d JOIN w ON d.source IS NOT DISTINCT FROM w.source
JOIN cell ON cell.k = w.k AND cell.i = ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '~' || md5(text), '')), 1, 15))::BIGINT % n
"""
