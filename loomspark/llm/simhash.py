"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut in two segments of 32 bits.  Two fingerprints within 2 bits differ by 1 at most in one
segment, so for each segment the Hamming ball of radius 1 around its value is enumerated, the table of that segment is
probed, and matches are verified over all 64 bits.  A table bucket of more than ``HEAVY`` fingerprints is not matched
member by member: probes that reach it enumerate the rest of their ball in the other segment too and look the complete
fingerprints up, so work stays linear in the number of fingerprints however large a group of near copies is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import grown, stash, tune
from loomspark.llm.components import components

SHINGLE, SEED, RADIUS, HALF = 3, 42, 2, 32
#: Fingerprints of a bucket up to which members are compared one by one: a full ball has 529 or 33 probes.
HEAVY = 256
#: Hashes turned into bit counts at a time.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if n > 1 or len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` of every text: a hash of the text that tells rows of one id apart, and the 64 bits as a signed long."""
    tune(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) key", "text").mapInArrow(run, "doc_id long, key long, fp long")


def _masks(weights: Iterable[int]) -> list[int]:
    found = []
    for w in weights:
        found += [0] if w == 0 else [1 << i for i in range(HALF)] if w == 1 else [1 << i | 1 << j for i in range(HALF) for j in range(i)]
    return found


def _array(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def linked(distinct: DataFrame) -> DataFrame:
    """Pairs ``a < b`` (signed) of the distinct fingerprints ``fp`` that differ in 1 to 2 bits; a pair may come twice.

    Each fingerprint gives 2 table rows and about 34 probes: of the two that differ by one bit in a segment, the one
    with that bit clear probes.  Only the heavy buckets, 1 in 128 fingerprints at most, may be broadcast.
    """
    low = F.lit((1 << HALF) - 1)
    halves = F.array(F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(low).alias("seg")), F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", HALF).alias("seg")))
    table = distinct.select("fp", F.inline(halves))
    heavy = table.groupBy("side", "seg").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("side", "seg")
    light = table.join(heavy, ["side", "seg"], "left_anti")
    entries = light.select("side", "seg", F.col("fp").alias("other")).unionByName(heavy.withColumn("other", F.lit(None).cast("long")).withColumn("is_heavy", F.lit(True)), allowMissingColumns=True)
    probes = table.select("fp", "side", "seg", F.explode(_array(_masks([0, 1]))).alias("mask")).where(F.col("mask").bitwiseAND(F.col("seg")) == 0)
    probes = probes.select("fp", "side", F.col("seg").bitwiseXOR(F.col("mask")).alias("seg"), "mask")
    met = grown(probes).join(grown(entries), ["side", "seg"])

    exact = F.col("mask") == 0
    near = met.where(F.col("is_heavy").isNull() & (~exact | (F.col("fp") < F.col("other"))) & F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).between(1, RADIUS))
    near = near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    # The rest of the ball in the other segment; complete fingerprints are looked up.
    rest = F.explode(F.when(exact, _array(_masks([1, 2]))).otherwise(_array(_masks([0, 1])))).alias("rest")
    shift = lambda column, up: F.when(up, F.shiftleft(column, HALF)).otherwise(F.col(column))
    ball = met.where("is_heavy").select("fp", "side", "mask", rest)
    ball = ball.select("fp", F.col("fp").bitwiseXOR(shift("mask", F.col("side") == 1)).bitwiseXOR(shift("rest", F.col("side") == 0)).alias("other"), "mask")
    ball = ball.where((F.col("mask") != 0) | (F.col("fp") < F.col("other")))
    sure = ball.join(grown(distinct.select(F.col("fp").alias("other"))), "other", "left_semi").select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return near.unionByName(sure)


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp, class, component_id`` of every row; ``class`` is a fingerprint of the group, see :func:`simhash_groups`."""
    prints, _ = stash(fingerprints(docs), "fingerprints")
    named, _ = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots, _ = components(linked(named.select("fp")), "a", "b")
    classes = grown(named).join(grown(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = grown(classes.select("fp", "class")).join(grown(least), "class")
    return prints.join(grown(classes), "fp", "left").select("doc_id", "key", "fp", "class", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups: ``doc_id, fingerprint`` (16 hex digits)``, component_id`` (smallest id reachable).

    Texts without words (null, empty, white space) have fingerprint zero and link like any other.  A row without an id
    gets its fingerprint and no component: it names no document.  Repeated rows give repeated rows, an empty table none;
    other columns are not read.  Links are sought between distinct fingerprints, so exact copies cost one row each.  A
    very long text is hashed STEP shingles at a time.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every near-duplicate group, with all columns as they are.

    It is that of the smallest id (of the smallest hash of the text, if the id has several texts in the group); a group
    of rows without ids keeps one of them.  An id whose texts are in several groups keeps one row in each.  Of rows that
    repeat both id and text one stays, whichever.
    """
    members = grouped(docs).groupBy("class", "doc_id", "key").agg(F.count("*").alias("n"))
    stay = members.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "n")).alias("m"))
    stay, _ = stash(stay.select(F.col("m.doc_id").alias("__id"), F.col("m.key").alias("__key"), (F.col("m.n") > 1).alias("__repeated")), "groups")
    kept = docs.join(grown(stay), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if stay.where("__repeated").isEmpty():
        return kept.select(*own)
    return kept.where("not __repeated").select(*own).unionByName(kept.where("__repeated").dropDuplicates(["__id", "__key"]).select(*own))
