"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units after numbers, and names (words that begin with a capital, wherever they stand) become typed
placeholders; other words are lower-cased.  A window of five words has three forms: its template, its template without
names (for copies in lower case or capitals), and its plain words.  Windows are hashed and hash-joined with those of the
benchmark, so a question matches whatever its parameters are.  The values behind placeholders are kept: on an alignment
of a document with an item, values must map one to one (the same value of the item becomes the same value of the
document, and back), and a match with a value that doesn't is no match.

An item is found in a document that holds 0.8 of its windows with enough literal words, if these are most of its windows,
or else 0.8 of all its windows; windows with fewer literal words match by their plain words alone.

Hashes alone come first: they tell the few pairs that have enough matches in any alignment, and only for these documents
are values gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import stash

#: Words of a window, words of a template that must be literal, share of an item's windows that contaminates, share of an item's windows that must be literal enough to decide alone.
WORDS, LITERAL, SHARE, MOST = 5, 3, 0.8, 0.5
#: Benchmark windows (about 60 bytes each) up to which they are broadcast; contaminated rows likewise.
BROADCAST = 500_000
NUMBER, UNIT, NAME = "#", "&", "@"
#: A number, or a word.
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|[a-zA-Z0-9\p{L}\p{M}\p{N}]+"
UNITS = (
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet ft yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees celsius fahrenheit kmh mph watt watts volt volts"
).split()
KEY = ["doc_id", "text_key"]


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _forms(rows: DataFrame, of: str) -> DataFrame:
    """``rows`` with ``__token``, the words, ``__lower``, their forms without names, and ``__form``, their forms with them.

    ``of`` makes a form of a word, an SQL expression with {} for it: the word itself, or its hash.  No word begins with a
    mark, so those before ':' in order of bytes are numbers, and most of those from 'a' on have no capital.
    """
    rows = rows.withColumn("__token", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({TOKEN})"), F.lit(0)))
    lower = f"""zip_with(__token, concat(array(''), __token), (x, before) -> case
        when x < ':' then {of.format(f"'{NUMBER}'")}
        when before < ':' and before > '' and lower(x) in ({_quoted(UNITS)}) then {of.format(f"'{UNIT}'")}
        else {of.format("lower(x)")} end)"""
    # The last of the words has no word after it: the array with those before is longer by one.
    rows = rows.withColumn("__lower", F.expr(f"slice({lower}, 1, size(__token))"))
    form = f"""transform(__token, (x, i) -> case
        when x between 'a' and 'zzzzzzzz' or x < ':' or left(x, 1) = lower(left(x, 1)) or __lower[i] = {of.format(f"'{UNIT}'")} then __lower[i]
        else {of.format(f"'{NAME}'")} end)"""
    return rows.withColumn("__form", F.expr(form))


def _is_slot(form: str) -> str:
    return f"{form} in ('{NUMBER}', '{UNIT}', '{NAME}')"


def _at(name: str, words: int = WORDS) -> str:
    return ", ".join(f"{name}[i + {k}]" for k in range(words))


def _cut(made: str, words: int = WORDS, where: str = "true") -> str:
    """An array with ``made`` for each ``i`` at which a window begins, none if the text is shorter or not ``where``."""
    return f"case when size(__token) >= {words} and {where} then transform(sequence(0, size(__token) - {words}), i -> {made}) else array() end"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``h, item_id, item_pos, literal, n_literal, n_windows, n_words, item_slots, item_types``: the forms of the items' windows.

    ``literal`` marks places where the template is literal enough, ``n_literal`` counts an item's; ``n_windows`` counts
    all.  A template is literal enough with LITERAL words that are no placeholders; where not even the one without names
    is, the plain words stand in.  An item of fewer words than a window has one, its plain words.
    """
    rows = _forms(items.where("item_id is not null").selectExpr("cast(item_id as long) item_id", "text"), "{}")
    rows = rows.withColumn("__raw", F.expr("transform(__token, x -> lower(x))"))
    literal = lambda name: f"size(filter(array({_at(name)}), x -> not {_is_slot('x')})) >= {LITERAL}"
    raw = f"array({_at('__raw')})"
    kinds = [("__form", literal("__form")), ("__lower", literal("__lower")), ("__raw", f"not {literal('__lower')}")]
    made = [_cut(f"case when {fits} then struct(i as item_pos, {literal('__form')} as literal, array({_at(name)}) as item_types, {raw} as words) end") for name, fits in kinds]
    made.append(f"case when size(__raw) between 1 and {WORDS - 1} then array(struct(0 as item_pos, false as literal, __raw as item_types, __raw as words)) else array() end")
    rows = rows.select("item_id", F.explode_outer(F.expr(f"filter(concat({', '.join(made)}), w -> w is not null)")).alias("w")).select("item_id", "w.*").where("item_pos is not null")
    hashed = " ".join(f"when {n} then xxhash64({', '.join(f'xxhash64(item_types[{k}])' for k in range(n))})" for n in range(1, WORDS + 1))
    rows = rows.withColumn("h", F.expr(f"case size(item_types) {hashed} end"))
    rows = rows.groupBy("item_id", "item_pos", "h").agg(F.max("literal").alias("literal"), F.first("item_types").alias("item_types"), F.first("words").alias("words"))
    totals = rows.groupBy("item_id").agg(F.expr("count(distinct case when literal then item_pos end)").alias("n_literal"), F.countDistinct("item_pos").alias("n_windows"))
    slots = F.expr(f"case when exists(item_types, x -> {_is_slot('x')}) then words end").alias("item_slots")
    return rows.join(totals, "item_id").select("h", "item_id", "item_pos", "literal", "n_literal", "n_windows", F.size("item_types").alias("n_words"), slots, "item_types")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__plain", F.expr("transform(__token, x -> xxhash64(lower(x)))"))


def _hashes(docs: DataFrame, plain: bool, short: list[int]) -> DataFrame:
    """``doc_id, text_key, h``: the hashes of all forms of all windows.

    Places are exploded and hashed in generated code.  Explode them with ``explode_outer``: for an inner one the optimizer
    infers a filter on the array's size, pushes it below the projections, and so evaluates them all again inside it.
    """
    rows = _plain(_forms(docs, "xxhash64({})")) if plain or short else _forms(docs, "xxhash64({})")
    least = min([WORDS, *short])
    rows = rows.withColumn("i", F.explode_outer(F.expr(f"case when size(__token) >= {least} then sequence(0, size(__token) - {least}) end"))).where("i is not null")
    window = lambda name, n=WORDS: f"xxhash64({', '.join(f'get({name}, i + {k})' for k in range(n))})"
    full = "i + {} <= size(__token)".format
    forms = [window("__lower"), window("__form"), *([window("__plain")] if plain else [])]
    if not short:
        forms = [forms[0], *(f"nullif({x}, {forms[0]})" for x in forms[1:])]
    else:
        forms = [f"case when {full(WORDS)} then {x} end" for x in forms] + [f"case when {full(n) if n > 1 else 'size(__token) = 1'} then {window('__plain', n)} end" for n in short]
    return rows.select(*KEY, F.explode(F.expr(f"array({', '.join(forms)})")).alias("h")).where("h is not null")


def _with_values(docs: DataFrame, plain: bool, short: list[int]) -> DataFrame:
    """``docs`` with ``__windows``, ``pos, h, slots`` of all forms of all windows; ``slots`` are the plain words."""
    rows = _plain(_forms(docs, "xxhash64({})")).withColumn("__raw", F.expr("transform(__token, x -> lower(x))"))
    struct = lambda name, n=WORDS, where="true": _cut(f"struct(i as pos, xxhash64({_at(name, n)}) as h, array({_at('__raw', n)}) as slots)", n, where)
    arrays = [struct("__lower"), struct("__form", where="__form <> __lower"), *([struct("__plain", where="__plain <> __lower")] if plain else [])]
    arrays += [struct("__plain", n, "size(__token) = 1" if n == 1 else "true") for n in short]
    return rows.withColumn("__windows", F.expr(f"concat({', '.join(arrays)})"))


def _enough(share: float) -> str:
    """Whether ``m_literal`` of the literal windows, or ``m`` of all windows, are an item's share."""
    return f"(n_literal >= {MOST} * n_windows and m_literal >= {share} * n_literal) or m >= {share} * n_windows"


def _found(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """``doc_id, text_key, item_id, n_windows, n_matched, reparameterised`` of contaminated rows."""
    windows, _ = stash(benchmark_windows(items), "benchmark")
    near = F.broadcast(windows) if windows.count() <= BROADCAST else windows
    sizes = sorted(r.n_words for r in windows.where(F.col("n_words") < WORDS).select("n_words").distinct().collect())  # 4 values at most
    plain = not windows.where((F.col("n_words") == WORDS) & ~F.exists("item_types", lambda x: x.isin(NUMBER, UNIT, NAME)) & F.exists("item_types", lambda x: F.ascii(x).between(48, 57))).isEmpty()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    # An upper bound of what any alignment can have, by hashes alone.
    hits = _hashes(docs, plain, sizes).join(near.select("h", "item_id", "item_pos", "literal", "n_literal", "n_windows"), "h").drop("h").distinct()
    counts = hits.groupBy(*KEY, "item_id").agg(F.countDistinct(F.when(F.col("literal"), F.col("item_pos"))).alias("m_literal"), F.countDistinct("item_pos").alias("m"), F.max("n_literal").alias("n_literal"), F.max("n_windows").alias("n_windows"))
    pairs, _ = stash(counts.where(_enough(share)).select(*KEY, "item_id"), "candidates")

    few = pairs.count() <= BROADCAST
    texts = pairs.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    pairs = F.broadcast(pairs) if few else pairs
    chosen = docs.join(F.broadcast(texts) if few else texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi").distinct()
    rows = _with_values(chosen, plain, sizes).select(*KEY, F.explode_outer("__windows").alias("w")).select(*KEY, "w.pos", "w.h", "w.slots").join(near, "h")
    same = [rows["doc_id"].eqNullSafe(pairs["doc_id"]), rows["text_key"] == pairs["text_key"], rows["item_id"] == pairs["item_id"]]
    rows = rows.join(pairs, same[0] & same[1] & same[2], "left_semi")

    key = [*KEY, "item_id"]
    values = f"case when item_slots is not null then filter(transform(item_types, (x, i) -> struct(x as t, item_slots[i] as a, slots[i] as b)), v -> {_is_slot('v.t')}) else cast(array() as array<struct<t: string, a: string, b: string>>) end"
    # An alignment has a few matches at most for each window of the item, so its sets are no larger than the item.
    lines = rows.groupBy(*key, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.max("n_literal").alias("n_literal"), F.max("n_windows").alias("n_windows"), F.collect_set(F.struct("item_pos", "literal", F.expr(values).alias("ab"))).alias("ms"))
    lines = lines.withColumn("ab", F.expr("array_distinct(flatten(transform(ms, m -> m.ab)))"))
    # A value that maps to two, or to which two map, is a conflict.
    lines = lines.withColumn("bad", F.expr("filter(ab, v -> exists(ab, w -> w.t = v.t and (w.a = v.a) <> (w.b = v.b)))"))
    sound = lines.select(*key, "n_literal", "n_windows", F.explode_outer(F.expr("filter(ms, m -> not arrays_overlap(m.ab, bad))")).alias("m")).where("m is not null")
    found = sound.select(*key, "n_literal", "n_windows", "m.item_pos", "m.literal", F.expr("exists(m.ab, v -> v.a <> v.b)").alias("changed"))
    found = found.groupBy(*key).agg(F.max("n_literal").alias("n_literal"), F.max("n_windows").alias("n_windows"), F.countDistinct(F.when(F.col("literal"), F.col("item_pos"))).alias("m_literal"), F.countDistinct("item_pos").alias("m"), F.max("changed").alias("reparameterised"))
    found = found.where(_enough(share))
    by_all = F.expr(f"m >= {share} * n_windows")
    return found.select(*key, F.when(by_all, F.col("n_windows")).otherwise(F.col("n_literal")).alias("n_windows"), F.when(by_all, F.col("m")).otherwise(F.col("m_literal")).alias("n_matched"), "reparameterised")


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, n_windows, n_matched, reparameterised``.

    One row for each document id and item: how many windows decide, how many of them the document has, and whether
    values differ from the item's.  Null or empty texts match nothing; items without an id or without a word take no
    part; an item of two to four words is found as a sequence of plain words, an item of one word only as a whole text;
    repeated rows count once; a very long text is one array of words; an empty table on either side gives no rows; rows
    without a document id are reported with a null id.  Other columns are not read.

    The benchmark's windows are counted, and broadcast if they are few, so that only matches are shuffled.
    """
    found = _found(docs, items, share)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.max("reparameterised").alias("reparameterised"))


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns as they are."""
    bad, _ = stash(_found(docs, items, share).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "contaminated")
    if bad.count() <= BROADCAST:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def sql(share: float = SHARE) -> str:
    """The same pairs in DuckDB's SQL."""
    slots = f"('{NUMBER}', '{UNIT}', '{NAME}')"
    forms = lambda table, key: f"""
  SELECT *, list_transform(tok, lambda x, i: CASE WHEN low[i] IN ('{NUMBER}', '{UNIT}') OR left(x, 1) = lower(left(x, 1)) THEN low[i] ELSE '{NAME}' END) AS form
  FROM (SELECT *, list_transform(tok, lambda x, i: CASE
      WHEN ord(x) BETWEEN 48 AND 57 THEN '{NUMBER}'
      WHEN i > 1 AND ord(tok[i - 1]) BETWEEN 48 AND 57 AND raw[i] IN ({_quoted(UNITS)}) THEN '{UNIT}'
      ELSE raw[i] END) AS low
    FROM (SELECT *, list_transform(tok, lambda x: lower(x)) AS raw FROM (SELECT {key}, text, regexp_extract_all(COALESCE(text, ''), '{TOKEN}') AS tok FROM {table})))"""  # noqa: E731
    part = lambda name: f"{name}[i:i + {WORDS - 1}]"
    cut = f"list_transform(range(1, len(tok) - {WORDS - 2}), lambda i: {{'pos': i, 'form': {part('form')}, 'low': {part('low')}, 'raw': {part('raw')}}})"
    literal = lambda name: f"len(list_filter({name}, lambda x: x NOT IN {slots})) >= {LITERAL}"
    same = "m.doc_id IS NOT DISTINCT FROM h.doc_id AND m.key = h.key AND m.item_id = h.item_id AND m.shift = h.shift"
    return f"""
WITH d AS ({forms('documents', 'doc_id')}), b AS ({forms('benchmark', 'item_id')}),
few AS (SELECT COALESCE(list(DISTINCT len(raw)), []) AS ns FROM b WHERE item_id IS NOT NULL AND len(raw) BETWEEN 2 AND {WORDS - 1}),
dall AS (SELECT doc_id, md5(text) AS key, unnest({cut}) AS w FROM d),
dw AS (SELECT doc_id, key, w.pos AS pos, w.raw AS raw, unnest([w.form, w.low, w.raw]) AS words FROM dall
  UNION ALL SELECT doc_id, md5(text), 1, raw, raw FROM d WHERE len(raw) = 1
  UNION ALL SELECT doc_id, key, w.pos, w.raw, w.raw FROM (SELECT doc_id, md5(text) AS key, unnest(flatten(list_transform(ns, lambda n: list_transform(range(1, len(tok) - n + 2), lambda i: {{'pos': i, 'raw': raw[i:i + n - 1]}})))) AS w FROM d, few)),
ball AS (SELECT item_id, w.pos AS item_pos, w.raw AS item_raw, {literal('w.form')} AS literal, CASE WHEN {literal('w.form')} THEN [w.form, w.low] WHEN {literal('w.low')} THEN [w.low] ELSE [w.raw] END AS ways
  FROM (SELECT item_id, unnest({cut}) AS w FROM b WHERE item_id IS NOT NULL)
  UNION ALL SELECT item_id, 1, raw, false, [raw] FROM b WHERE item_id IS NOT NULL AND len(raw) BETWEEN 1 AND {WORDS - 1}),
bw AS (SELECT DISTINCT item_id, item_pos, item_raw, literal, unnest(ways) AS words FROM ball),
totals AS (SELECT item_id, count(DISTINCT CASE WHEN literal THEN item_pos END) AS n_literal, count(DISTINCT item_pos) AS n_windows FROM bw GROUP BY item_id),
hits AS (SELECT DISTINCT doc_id, key, pos, item_id, item_pos, literal, pos - item_pos AS shift, dw.words, raw, item_raw
  FROM (SELECT *, array_to_string(words, ' ') AS line FROM dw) dw JOIN (SELECT *, array_to_string(words, ' ') AS line FROM bw) bw USING (line)),
pairs AS (SELECT doc_id, key, item_id, shift, pos, words, words[k] AS t, item_raw[k] AS a, raw[k] AS b FROM hits, range(1, {WORDS + 1}) AS g(k) WHERE words[k] IN {slots}),
bad AS (SELECT DISTINCT h.doc_id, h.key, h.item_id, h.shift, h.pos, h.words FROM pairs h JOIN pairs m ON {same} AND m.t = h.t AND (m.a = h.a) <> (m.b = h.b)),
sound AS (SELECT h.*, EXISTS (SELECT 1 FROM pairs m WHERE {same} AND m.pos = h.pos AND m.words = h.words AND m.a <> m.b) AS changed
  FROM hits h WHERE NOT EXISTS (SELECT 1 FROM bad m WHERE {same} AND m.pos = h.pos AND m.words = h.words)),
found AS (SELECT doc_id, key, item_id, any_value(n_literal) AS n_literal, any_value(n_windows) AS n_windows, count(DISTINCT CASE WHEN literal THEN item_pos END) AS m_literal, count(DISTINCT item_pos) AS m, max(changed) AS changed
  FROM sound JOIN totals USING (item_id) GROUP BY doc_id, key, item_id)
SELECT doc_id, item_id, max(CASE WHEN m >= {share} * n_windows THEN n_windows ELSE n_literal END) AS n_windows, max(CASE WHEN m >= {share} * n_windows THEN m ELSE m_literal END) AS n_matched, max(changed) AS reparameterised
FROM found WHERE {_enough(share)} GROUP BY doc_id, item_id
"""
