"""Shards by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

A document's hash is the first 60 bits of the MD5 of its id.  Sizes are summed once for cells of a prefix a little deeper
than an even spread needs; the buckets of every shorter prefix are sums of cells, and the shards are the shortest
prefixes that fit the limit.  Cells that don't fit by themselves are summed again at a deeper prefix, the others not.  A
bucket of one hash that is too large even so holds rows of one id: its rows are written down and split on, in the same
way, by a hash of where they are written.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import discard, stash

#: Hash bits; byte limit of a shard, shards that the input makes at least (smaller inputs have a smaller limit); bits of a cell beyond those that an even spread needs, further bits at a time.
BITS, LIMIT, SPREAD, FINE, DEEPER = 60, 64 << 20, 32, 3, 12
#: Shards (about 60 bytes each) up to which the directory is broadcast.
BROADCAST = 500_000


def _bits_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def hash_bits() -> Column:
    """The hash of the id; rows without one are told apart by their text."""
    return _bits_of(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5("text")), F.lit("")))


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _leaves(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """``level, node`` of the shortest prefixes, not shorter than ``top``, that fit, and the cells that fit none (level null); rows have ``__group, cell, n, bytes``."""
    nodes = cells.select("__group", "cell", "n", "bytes", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("level")).withColumn("node", F.expr(f"shiftright(cell, cast({depth} - level as int))"))
    sums = nodes.groupBy("__group", "level", "node").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("bytes") <= limit) | (F.col("n") == 1))
    fits = nodes.select("__group", "cell", "level", "node").join(sums.select("__group", "level", "node"), ["__group", "level", "node"]).groupBy("__group", "cell").agg(F.min("level").alias("level"))
    found = cells.select("__group", "cell").join(fits, ["__group", "cell"], "left")
    return found.select("__group", "level", F.coalesce(F.expr(f"shiftright(cell, cast({depth} - level as int))"), "cell").alias("node")).distinct()


def directory(sized: DataFrame, limit: int, total: int) -> tuple[DataFrame, bool]:
    """``__group, level, node`` of the shards of the rows ``(__group, __bits, __bytes)``, and whether any bucket of all bits is too large (level null)."""
    depth = min(BITS, max(0, ceil(log2(max(1, total / limit)))) + FINE)
    top, found = 0, []
    while True:
        cells, cells_path = stash(sized.groupBy("__group", F.shiftright("__bits", BITS - depth).alias("cell")).agg(F.count("*").alias("n"), F.sum("__bytes").alias("bytes")), "cells")
        leaves, _ = stash(_leaves(cells, top, depth, limit), "leaves")
        discard(sized.sparkSession, cells_path)
        rest = leaves.where("level is null")
        over = not rest.isEmpty()
        found.append(leaves if depth == BITS else leaves.where("level is not null"))
        if depth == BITS or not over:
            return reduce(DataFrame.unionByName, found), over
        rest = rest.select("__group", F.col("node").alias("cell"))
        sized = sized.join(rest, (sized["__group"] == rest["__group"]) & (F.shiftright("__bits", BITS - depth) == F.col("cell")), "left_semi")
        top, depth = depth + 1, min(BITS, depth + DEEPER)


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` (with ``__group, __bits``) joined to the shard that holds them, as ``__level`` (null: too large)."""
    levels = [r.level for r in leaves.select(F.coalesce("level", F.lit(BITS)).alias("level")).distinct().collect()]  # 61 values at most
    table = leaves.select(F.col("__group").alias("__g"), F.coalesce("level", F.lit(BITS)).alias("__at"), "node", F.col("level").alias("__level"))
    if leaves.count() <= BROADCAST:
        table = F.broadcast(table)
    tried = rows.withColumn("__try", F.explode_outer(F.array(*map(F.lit, sorted(levels)))))
    here = (F.col("__group") == F.col("__g")) & (F.col("__try") == F.col("__at")) & (F.expr(f"shiftright(__bits, cast({BITS} - __try as int))") == F.col("node"))
    return tried.join(table, here).drop("__try", "__g", "__at", "node")


def _prefix(depth: Column) -> Column:
    return F.substring(F.lpad(F.conv(F.col("__bits").cast("string"), 10, 2), BITS, "0"), F.lit(1), depth)


def assign(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` (the shard's prefix as bits, empty for a single shard) and ``shard_depth``; see :func:`shards`."""
    if limit is not None and limit < 1:
        raise ValueError("the limit must be positive")
    none = docs.withColumns({"shard": F.lit(""), "shard_depth": F.lit(0)})
    total = docs.agg(F.sum(text_bytes())).first()[0]
    if total is None:
        return none
    limit = limit or min(LIMIT, max(1, -(-total // SPREAD)))
    rows = docs.withColumns({"__group": F.lit(0).cast("long"), "__bits": hash_bits()})
    leaves, over = directory(rows.select("__group", "__bits", text_bytes().alias("__bytes")), limit, total)
    placed = _placed(rows, leaves)
    out = placed.where("__level is not null").withColumns({"shard": _prefix(F.col("__level")), "shard_depth": F.col("__level")})
    if over:
        large, _ = stash(placed.where("__level is null").withColumn("__group", F.col("__bits")).drop("__level"), "large")
        where = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
        large = large.select("*", _prefix(F.lit(BITS)).alias("__head"), _bits_of(where).alias("__where")).drop("__bits").withColumnRenamed("__where", "__bits")
        size = large.groupBy("__group").agg(F.sum(text_bytes()).alias("bytes")).agg(F.max("bytes")).first()[0]
        leaves, _ = directory(large.select("__group", "__bits", text_bytes().alias("__bytes")), limit, size)
        parts = _placed(large, leaves)
        depth = F.coalesce("__level", F.lit(BITS))
        parts = parts.withColumns({"shard": F.concat("__head", F.lit("+"), _prefix(depth)), "shard_depth": F.lit(BITS) + depth}).drop("__head")
        out = out.unionByName(parts)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "shard_depth")], "shard", F.col("shard_depth").cast("int").alias("shard_depth"))


def shards(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """The shard of every document: ``doc_id, n_bytes, shard, shard_depth``.

    ``shard`` is the hash prefix as a string of bits, ``shard_depth`` its length.  Every shard holds ``limit`` bytes of
    text at most, but for a shard of one document that is larger by itself; the default is LIMIT, or less where the input
    wouldn't make SPREAD shards.  Null texts have no bytes, rows without an id are hashed by their text, ties don't arise
    (a document's shard depends on its hash and the sizes alone), rows of one id stay together until they exceed the
    limit and are then split by a second hash (``+`` and its prefix); an empty table gives no rows.  Only ids and sizes
    are shuffled, summed for cells before; the directory of shards is broadcast if it is small, else joined.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("n_bytes"), "text")
    return assign(wanted, limit).select("doc_id", "n_bytes", "shard", "shard_depth")


def sql(limit: int = LIMIT, spread: int = SPREAD) -> str:
    """The same shards in DuckDB's SQL, as long as no id's rows exceed the limit."""
    return f"""
WITH d AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '~' || md5(text), '')), 1, 15))::BIGINT AS b
  FROM documents),
top AS (SELECT least({limit}, greatest(1, (sum(n_bytes) + {spread} - 1) // {spread})) AS most FROM d),
nodes AS (
  SELECT g.level::INT AS level, b >> ({BITS} - g.level)::INT AS node, sum(n_bytes) AS bytes, count(*) AS n
  FROM d, generate_series(0, {BITS}) AS g(level) GROUP BY ALL),
fits AS (SELECT level, node FROM nodes, top WHERE bytes <= most OR n = 1),
leaf AS (SELECT d.b, min(f.level) AS depth FROM (SELECT DISTINCT b FROM d) d JOIN fits f ON d.b >> ({BITS} - f.level)::INT = f.node GROUP BY d.b)
SELECT d.doc_id, d.n_bytes, left(lpad(bin(d.b), {BITS}, '0'), leaf.depth) AS shard, leaf.depth::INT AS shard_depth
FROM d JOIN leaf ON d.b = leaf.b
"""
