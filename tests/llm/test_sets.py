"""Operators on whole tables against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import ann, components, decontam, mixing, sharding, simhash, style_tree

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# -- SimHash
def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("heavy", [256, 0])
def test_groups(spark, documents, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in documents.collect()}
    want = plain_groups(prints)
    for r in simhash.simhash_groups(documents).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("heavy", [256, 3, 0])
def test_links_of_dense_fingerprints(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(heavy)
    centre = [rng.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) & (1 << 64) - 1 for c in centre for _ in range(60)} | {0, (1 << 64) - 1}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.linked(df).collect()}
    want = {frozenset((signed(a), signed(b))) for a in values for b in values if a != b and (a ^ b).bit_count() <= 2}
    assert got == want


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    distinct, _ = simhash.stash(spark.range(3000).select(F.xxhash64("id").alias("fp")), "distinct")
    assert "SortMergeJoin [side#" in _final_plan(simhash.linked(distinct))
    monkeypatch.setattr(simhash, "HEAVY", 0)
    assert "SortMergeJoin [other#" in _final_plan(simhash.linked(distinct))
    docs = spark.range(3000).selectExpr("id doc_id", "concat_ws(' ', id, id + 1, id % 7, id * id) text")
    assert "Broadcast" not in _final_plan(simhash.grouped(docs))
    assert "Broadcast" not in _final_plan(simhash.keep_one(docs))

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "a long, b long")
    seen = []
    monkeypatch.setattr(components, "FEW", 10)
    monkeypatch.setattr(components, "stash", lambda df, label: (seen.append(_final_plan(df)), simhash.stash(df, label))[1])
    roots = {r.node: r.root for r in components.components(links, "a", "b")[0].collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
    assert len(seen) > 2 and not any("Broadcast" in plan for plan in seen)


def test_odd_texts_and_ids(spark):
    rows = [(5, None, "x"), (3, " \t", "y"), (9, "One", "y"), (9, "one", "y"), (None, "one", "z"), (4, "é É", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()}
    one = f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert {(5, "0" * 16, 3), (3, "0" * 16, 3), (9, one, 9), (None, one, None)} <= got
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [3, 4, 9]
    several = [(9, "one", "a"), (9, "one", "b"), (9, "two other words", "c"), (None, "no id", "d"), (None, "no id", "d"), (8, "two other words", "e")]
    kept = simhash.keep_one(spark.createDataFrame(several, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "no id"), (8, "two other words"), (9, "one")]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_long_text_is_hashed_in_steps(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    whole = simhash.fingerprint(text)
    assert whole == plain_fingerprint(text)
    for step in (1, 7, 498, 499):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash.fingerprint(text) == whole


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 260)] + [(7, 7), (301, 300), (300, 301)]
    roots, _ = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    got = {r.node: r.root for r in roots.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 200 for i in range(201, 260)} | {301: 300}


# -- nearest neighbours
def embeddings(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row], "q") for i, row in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, rank string")


def plain_nearest(ids, x, i, k):
    d = np.sqrt(((x.astype(np.float32).astype(float) - x[i].astype(np.float32).astype(float)) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if j != i][:k]
    return [(int(ids[j]), d[j]) for j in order]


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for i in np.flatnonzero(ids % 100 == 0):
        want = plain_nearest(ids, x, i, 10)
        mine = got[int(ids[i])]
        assert sorted(mine) == list(range(1, 11))
        scores = dict(want)
        assert all(abs(s - scores[v]) < 1e-12 for v, s in mine.values() if v in scores)
        hit += len({v for v, _ in want} & {v for v, _ in mine.values()})
    assert hit >= 0.9 * 10 * len(got)


def test_odd_vectors_and_ties(spark):
    x = np.array([[0.0, 1.0], [0.0, 1.0], [0.0, 1.0], [1.0, 0.0]])
    bad = [(10, None, "q"), (11, [0.0, 0.0], "q"), (12, [float("nan"), 1.0], "q"), (13, [None, 1.0], "q"), (14, [1.0], "q"), (None, [1.0, 1.0], "q"), (3, [1.0, 0.0], "q")]
    got = ann.nearest(embeddings(spark, x, bad), F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 0.0), (2, 0.0), (3, 1.414214)]
    assert ann.nearest(embeddings(spark, x).limit(0), F.col("vec_id") == 0).count() == 0


def test_far_queries_are_not_short(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 16)) * 0.01 + 1, -np.ones((1, 16))])
    got = ann.nearest(embeddings(spark, x), F.col("vec_id") == 300, k=10).collect()
    assert {r.vec_id for r in got} == {v for v, _ in plain_nearest(np.arange(301), x, 300, 10)}


@pytest.mark.parametrize("radius", [0, 3, 17, 18, 40, 64])
def test_tables_retrieve_every_code(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 16, (40, 4)).astype(np.uint16)
    codes = (base[rng.integers(0, 40, 3000)] ^ (1 << rng.integers(0, 16, (3000, 4))).astype(np.uint16) * (rng.random((3000, 4)) < 0.4)).astype(np.uint16)
    tables = ann.Tables(codes)
    ham = ann.distances(codes[:20], codes)
    for i, query in enumerate(codes[:20]):
        found, bits = tables.within(query, radius)
        assert (found == np.flatnonzero(ham[i] <= radius)).all() and (bits == ham[i][found]).all()
        # What is probed is what the pigeonhole principle says, and no more.
        r, a = divmod(radius, 4)
        near = [np.bitwise_count(codes[:, j] ^ query[j]) <= (r if j <= a else r - 1) for j in range(4)]
        assert (tables.probed(query, radius) == np.flatnonzero(np.any(near, 0))).all()


def test_queries_in_several_passes(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 20))
    want = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(embeddings(spark, x), F.col("vec_id") % 4 == 0).collect()}
    monkeypatch.setattr(ann, "QUERIES", 20 * 8 * 30)
    monkeypatch.setattr(ann, "BLOCK", 20 * 8 * 50)
    monkeypatch.setattr(ann, "YIELD", 7)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(embeddings(spark, x), F.col("vec_id") % 4 == 0).collect()}
    assert len(want) == 1000 and got == want


# -- decontamination
def test_planted_and_reparameterised(spark):
    items = spark.createDataFrame([(1, "A train leaves Paris at 60 km per hour and meets Anna after 3 hours near Lyon"), (2, "too short"), (3, None), (None, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro text. A train leaves Berlin at 75 miles per hour and meets Boris after 8 hours near Bonn and so on", "x"),
        (2, "intro a train leaves Paris at 60 km per hour and meets Anna after 3 hours near Lyon, the end", "x"),
        (3, "A train leaves Paris at 60 km per hour, then something else entirely happens to everyone", "x"),
        (4, None, "x"), (5, "", "x"), (6, "two words", "x"), (None, "A train leaves Paris at 60 km per hour and meets Anna after 3 hours near Lyon", "x"),
    ], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, None} and all(r.item_id == 1 for r in got.values())
    assert got[1].reparameterised and not got[2].reparameterised
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(docs.limit(0), items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_inconsistent_slots_do_not_count(spark):
    items = spark.createDataFrame([(1, "we know that 5 and then 5 again with 7 and more words follow here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we know that 4 and then 4 again with 9 and more words follow here"), (2, "we know that 4 and then 6 again with 9 and more words follow here")], "doc_id long, text string")
    assert [(r.doc_id, r.reparameterised) for r in decontam.contaminated(docs, items).collect()] == [(1, True)]


def test_whole_items_in_the_documents(spark):
    documents, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in benchmark.collect()}
    want = set()
    for r in documents.collect():
        text = " " + " ".join(words(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if " " + " ".join(w) + " " in text}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(documents, benchmark).collect()}
    assert want and want <= got and len(got) <= 1.1 * len(want)


def test_names_at_starts_and_changed_case(spark):
    text = "Tom has 5 apples. Anna gives him 3 more apples. How many apples does Tom have now?"
    other = "Ben has 7 apples. Sara gives him 4 more apples. How many apples does Ben have now?"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = [other, text.lower(), text.upper(), text.lower().replace("5", "9"), "Intro. " + other, other.replace("does Ben", "does Sara"), "Ben has 7 pears. Nothing else of it is here."]
    got = {r.doc_id: r for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert [got[k].reparameterised for k in range(5)] == [True, False, False, True, True]


def test_items_of_numbers_and_short_items(spark):
    texts = ["Calculate 12 + 30 * 4 - 7 = ?", "What is 17 * 23?", "Paris", "1 2 3 4 5 6 7 8 9 10 and then we stop it"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = ["Now calculate 12 + 30 * 4 - 7 = 125 at once", "So: what is 17 * 23? It is 391.", "We went to Paris", "paris", texts[3], "What is 17 * 24?", "Calculate 12 + 30 * 4 - 8 = ?"]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (3, 2), (4, 3)}
    kept = decontam.decontaminate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items)
    assert {r.doc_id for r in kept.collect()} == {2, 5, 6}


def test_more_reparameterised_questions(spark):
    """Planted variants with names, numbers and units changed, in first position too, among other text."""
    frames = [
        "{A} bought {n} {u} of flour and {m} {u} of sugar for the bakery. How much did {A} carry home in total?",
        "If {A} drives {n} {u} before noon and {B} drives {m} {u} after lunch, who has covered the longer distance?",
        "What is the capital of {A} and how many people lived there in {n} according to the census?",
        "{A} and {B} share a room. {A} pays {n} dollars while {B} pays {m} dollars every week until they move out.",
        "The tank holds {n} litres of water when {A} opens the valve; after {m} minutes it is empty again. Find the flow.",
    ]
    names, units, rng = "Tom Anna Boris Clara Wei Priya Omar Greta Ivan Nadia".split(), ["kg", "pounds", "km", "miles"], random.Random(5)

    def made(f):
        a, b = rng.sample(names, 2)
        return f.format(A=a, B=b, n=rng.randint(2, 99), m=rng.randint(100, 999), u=rng.choice(units))

    items = spark.createDataFrame([(k, made(f)) for k, f in enumerate(frames)], "item_id long, text string")
    docs, want = [], set()
    for k in range(100):
        want.add((k, k % len(frames)))
        docs.append((k, rng.choice(["", "some words go before it here. ", "Note: "]) + made(frames[k % len(frames)]) + rng.choice(["", " And more text follows.", "\nthe end"])))
    docs += [(1000 + k, "Nothing of the kind is asked here, though {} has {} apples and the tank holds water.".format(rng.choice(names), k)) for k in range(30)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert len(got & want) >= 0.95 * len(want) and got <= want


def test_questions_in_lower_case_and_in_the_middle(spark):
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "Define entropy briefly please")], "item_id long, text string")
    docs = ["x What is the capital of Spain today", "what is the capital of france", "tell me what is the capital of Spain", "So: define entropy briefly please.", "the capital of France is known to all"]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 1), (2, 1), (3, 2)}


def test_repeated_rows_and_a_long_text(spark):
    item = "A train leaves Paris at 60 km per hour and meets Anna after 3 hours near Lyon"
    items = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    long = "other words come first " * 20_000 + item + " and words go on " * 20_000
    rows = [(1, item, "a"), (1, item, "b"), (2, long, "c"), (3, long.replace("Lyon", "Bonn").replace("60 km", "75 miles"), "d"), (4, "clean", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert sorted(r.doc_id for r in decontam.contaminated(docs, items).collect()) == [1, 2, 3]
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == [4]
    assert decontam.decontaminate(docs, items).columns == docs.columns


def _same_as_sql(spark, docs, items):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    got, want = decontam.contaminated(docs, items).toPandas(), con.execute(decontam.sql()).df()
    key = lambda d: sorted(map(tuple, d[["doc_id", "item_id", "n_windows", "n_matched", "reparameterised"]].values.tolist()))
    assert len(want) and key(got) == key(want)


def test_odd_items_as_in_sql(spark):
    texts = ["Calculate 12 + 30 * 4 - 7 = ?", "What is 17 * 23?", "Paris", "1 2 3 4 5 6 7 8 9 10 and then we stop it", "Tom has 5 apples. Anna gives him 3 more apples. How many apples does Tom have now?", "\u00c9mile court 5 Km et \u00c9mile boit 3 l", "", None]
    docs = ["Now calculate 12 + 30 * 4 - 7 = 125 at once", "So: what is 17 * 23?", "paris", texts[3], texts[4].upper(), texts[4].replace("Tom", "Ben").replace("5", "8.5"), texts[4].replace("does Tom", "does Anna"), texts[5].lower(), texts[5].replace("5", "7"), "", None]
    _same_as_sql(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = decontam.contaminated(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))).toPandas()
    want = con.execute(decontam.sql()).df()
    key = lambda d: sorted(map(tuple, d[["doc_id", "item_id", "n_windows", "n_matched", "reparameterised"]].values.tolist()))
    assert len(want) and key(got) == key(want)


# -- sharding
def check_shards(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sum(r.n_bytes for r in rs) <= limit or len(rs) == 1 for rs in by.values())
    plain = [s for s in by if "+" not in s]
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)
    return by


@pytest.mark.parametrize("limit", [1, 3000, 20_000, 1 << 30, None])
def test_shards_fit_and_match_sql(spark, documents, limit, monkeypatch):
    got = sharding.shards(documents, limit).toPandas()
    total = int(got.n_bytes.sum())
    by = check_shards(list(got.itertuples()), limit or -(-total // sharding.SPREAD))
    assert limit or len(by) >= sharding.SPREAD
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.execute(sharding.sql(limit, 1) if limit else sharding.sql()).df()
    key = lambda d: sorted(map(tuple, d[["doc_id", "n_bytes", "shard", "shard_depth"]].values.tolist()))
    assert key(got) == key(want)
    monkeypatch.setattr(sharding, "BROADCAST", 0)
    assert key(sharding.shards(documents, limit).toPandas()) == key(got)


def test_one_id_and_odd_rows(spark):
    df = spark.createDataFrame([(7, "x" * 100, "c")] * 50 + [(None, None, "c"), (None, None, "d"), (None, "z", "c"), (8, "y" * 5000, "c")], "doc_id long, text string, bytes string")
    rows = sharding.shards(df, 1000)
    got = rows.collect()
    check_shards(got, 1000)
    assert len(got) == 54 and sum(r.n_bytes for r in got) == 10_001
    assert len({r.shard for r in got if r.doc_id == 7}) >= 5 and sorted(map(str, rows.collect())) == sorted(map(str, got))
    assert sharding.assign(df, 1000).columns == ["doc_id", "text", "bytes", "shard", "shard_depth"]
    assert sharding.shards(df.limit(0), 1000).count() == 0 and sharding.shards(df.limit(0)).columns == ["doc_id", "n_bytes", "shard", "shard_depth"]


def test_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"{i:04d}" * 500, "s") for i in range(100)], "doc_id long, text string, source string")
    check_shards(sharding.shards(df, 10_000).collect(), 10_000)
    blocks = {r.block for r in mixing.mixed(df, block=2000).collect()}
    assert len(blocks) > 50


# -- mixing
@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0}, {"a": 0.7, "b": 0.2, None: 0.1}, {str(i): 1 + i * i for i in range(30)}, {str(i): 0.97 if i == 0 else 1e-4 for i in range(300)}])
def test_schedule_keeps_within_a_block(weights):
    total = sum(weights.values())
    had = dict.fromkeys(weights, 0)
    for source, block, slot, release, deadline in itertools.islice(mixing.schedule(weights, dict.fromkeys(weights, 10_000)), 5000):
        assert block == had[source] and release <= slot < deadline
        had[source] += 1
        assert all(abs(n - (slot + 1) * weights[s] / total) < 1 + 1e-9 for s, n in had.items())


def test_mixed_rows(spark, documents):
    got = mixing.mixed(documents, block=2000).collect()
    assert len(got) == documents.count()
    slot = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert slot.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    mix = mixing.mixture(documents, block=2000)
    assert mix.schema == documents.schema
    order = {r.doc_id: r.slot for r in got}
    slots = [order[r.doc_id] for r in mix.collect()]
    assert slots == sorted(slots) and len(slots) == len(order)


@pytest.mark.parametrize("block", [500, 20_000, None])
def test_mixing_matches_sql(spark, documents, block):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got, want = mixing.mixed(documents, block=block).toPandas(), con.execute(mixing.sql(block, 1) if block else mixing.sql()).df()
    assert sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_mixing_edge_cases(spark, documents):
    odd = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "x", "a", 1)], "doc_id long, text string, source string, slot int")
    assert mixing.mixed(odd).count() == 3 and mixing.mixture(odd).columns == odd.columns
    assert mixing.mixed(documents.limit(0)).count() == 0 and mixing.mixture(documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(documents, {"src0": 1.0})


@pytest.mark.parametrize("n", [20, 100])
def test_given_weights_are_met_within_a_block(spark, n):
    weights = {str(k): 1 / 3 if k == 0 else 2 / 3 / (n - 1) for k in range(n)}
    blocks = {s: int(900 * w) + 1 for s, w in weights.items()}
    cells = list(mixing.schedule(weights, blocks))
    assert len(cells) == sum(blocks.values())
    had = dict.fromkeys(weights, 0)
    for source, block, slot, release, deadline in cells:
        assert block == had[source] and release <= slot < deadline
        had[source] += 1
        assert slot >= 880 or all(abs(had[s] - (slot + 1) * w) < 1 + 1e-9 for s, w in weights.items())
    docs = spark.createDataFrame([(k * 10_000 + i, "x", s) for k, (s, b) in enumerate(blocks.items()) for i in range(b)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, weights, block=1).collect()
    want = {(s, b): (slot, release, deadline) for s, b, slot, release, deadline in cells}
    assert len(got) == docs.count() and all(want[r.source, r.block] == (r.slot, r.release, r.deadline) for r in got)
    assert all(abs(r.block - r.slot * weights[r.source]) < 1 + 1e-9 for r in got)


def test_joined_schedule(spark, documents, monkeypatch):
    got = {(r.doc_id, r.slot) for r in mixing.mixed(documents, block=500).collect()}
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert len(got) == documents.count() and got == {(r.doc_id, r.slot) for r in mixing.mixed(documents, block=500).collect()}


def test_default_weights_and_blocks(spark, documents):
    """By default there are several blocks of each source, and no prefix of the mixture strays a block from the weights."""
    rows = mixing.mixed(documents).collect()
    sizes = {r.source: r.n for r in documents.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    weights = {s: int(n**mixing.ALPHA) for s, n in sizes.items()}
    block = -(-sum(sizes.values()) // mixing.SPREAD)
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    assert min(blocks.values()) > 5
    cells = {(r.source, r.block): r.slot for r in rows}
    want = {(s, b): slot for s, b, slot, _, _ in mixing.schedule(weights, blocks)}
    assert cells.items() <= want.items()


def test_positions_tell_the_order_that_was_written(spark, documents, tmp_path):
    slots = {r.doc_id: r.slot for r in mixing.mixed(documents).collect()}
    mixing.mixture(documents).write.parquet(f"file://{tmp_path}/mix")
    rows = mixing.positions(spark.read.parquet(f"file://{tmp_path}/mix")).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(slots)))
    order = [slots[r.doc_id] for r in rows]
    assert order == sorted(order)
    made = spark.createDataFrame([(3, "a"), (4, "b")], "doc_id long, position string").drop("position")
    assert {r.position for r in mixing.positions(made).collect()} == {0, 1}


# -- pages
SIDE = '<div class="box">Buy now &amp; save</div>'


def page(i, body="", side=SIDE):
    return (i, f"http://h.example/{i}", f"<html><head><title>T</title></head><body><nav><a>Home</a></nav>{side}{body}<footer>f</footer></body></html>", 1)


def texts(spark, rows):
    return [r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, low int")).orderBy("page_id").collect()]


def test_unimportant_branches_go(spark):
    rows = [page(i, f"<div class='story'><h1>Head {i}</h1><p>Word{i} a&lt;b\n  c<b>d</b></div>") for i in range(5)]
    assert texts(spark, rows) == [f"Head {i} Word{i} a<b cd" for i in range(5)]


def test_article_keeps_copies_but_not_furniture(spark):
    body = "<article><h1>Same</h1><p>All pages repeat this.<form>x</form><section class='comments'><p>me too</p></section></article>"
    assert texts(spark, [page(i, body) for i in range(4)]) == ["Same All pages repeat this."] * 4


def test_odd_pages(spark):
    rows = [(1, None, None, 1), (2, "no url", "", 1), (3, "http://x/", "plain  text", 1), (3, "http://x/", "plain  text", 1), (4, None, "<p>a<p>b" * 2000, 1)]
    got = texts(spark, rows)
    assert got[:4] == ["", "", "plain text", "plain text"] and got[4] == " ".join(["a", "b"] * 2000)
    assert style_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert style_tree.extract(deep, set()) == "x"


def test_the_tree_decides(spark):
    """Hashed class names and no article: only repetition over the host's pages tells what is furniture."""
    made = lambda i: f"<body><div class='x9f'><a href='/'>Home</a> <a href='/b'>Wares</a></div><div class='k2'><h2>Title {i}</h2><div><p>Story {i} goes on</p></div></div><div class='q7'>All rights with Foo</div></body>"
    rows = [(i, f"http://h.example/{i}", made(i), 1) for i in range(6)]
    assert texts(spark, rows) == [f"Title {i} Story {i} goes on" for i in range(6)]
    assert style_tree.extract(made(1), set()) == "Home Wares Title 1 Story 1 goes on All rights with Foo"
    assert texts(spark, rows[:1]) == ["Home Wares Title 0 Story 0 goes on All rights with Foo"]


def test_boilerplate_inside_of_articles(spark):
    long = "and a good many other words that this page alone has, of which there are plenty"
    made = lambda i: f"<article><h1>Title {i}</h1><div><a>Share</a> <a>Print</a></div><p>Story {i} {long}</p><p>Tell your friends!</p></article>"
    rows = [(i, f"http://h.example/{i}", made(i), 1) for i in range(8)]
    assert texts(spark, rows) == [f"Title {i} Story {i} {long}" for i in range(8)]


def test_words_of_classes_are_prior_knowledge_only(spark):
    made = lambda i: f"<div class='layout no-sidebar'><div class='post has-comments'><p class='social-history'>Important {i}</p><div class='menu-item recipe'>Soup {i}</div></div><div class='cookie-banner'>We use {i} cookies</div></div>"
    rows = [(i, f"http://h.example/{i}", made(i), 1) for i in range(5)]
    assert texts(spark, rows) == [f"Important {i} Soup {i}" for i in range(5)]
    assert texts(spark, rows[:1]) == ["Important 0 Soup 0"]
    only = [(i, f"http://h.example/{i}", f"<div class='widget'><p>Text {i}</p></div><div class='ad'>Buy</div>", 1) for i in range(5)]
    assert texts(spark, only) == [f"Text {i}" for i in range(5)]


def test_comments_and_teasers_as_articles(spark):
    made = lambda i: f"<main><article class='story'><p>Story {i}</p></article><article class='teaser'><p>Read this</p></article></main><div class='comments'><article><p>I, {i}, agree</p></article></div>"
    assert texts(spark, [(i, f"http://h.example/{i}", made(i), 1) for i in range(6)]) == [f"Story {i}" for i in range(6)]


def test_large_pages_and_joined_cuts(spark, monkeypatch):
    wide = "".join(f"<div class='c{chr(97 + k % 26)} d{k % 7}'><p>Part {k}</p></div>" for k in range(6000))
    rows = [page(i, f"<article><h1>Head {i}</h1><p>Word{i} and more</p></article>") for i in range(7)] + [(7, "http://h.example/7", "<div>" * 200 + wide + "</div>" * 200, 1), (8, "http://one.example/", "<p>Alone</p><nav>x</nav>", 1)]
    got = texts(spark, rows)
    assert got[:7] == [f"Head {i} Word{i} and more" for i in range(7)] and got[8] == "Alone"
    assert got[7] == " ".join(f"Part {k}" for k in range(6000))
    monkeypatch.setattr(style_tree, "BROADCAST", 0)
    monkeypatch.setattr(style_tree, "HOT", 2)
    assert texts(spark, rows) == got


def test_articles_of_the_table(spark):
    import html

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r for r in style_tree.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer)", r.html, re.S)[1]
        want = " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|br|h1)\b[^>]*>", body)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
