"""What the Jaccard join puts on disk: whole sets only of near pairs, no shuffle files of steps that have ended."""

import time

import numpy as np

from eventflow.llm import common, jaccard_join

PAIRS = "a long, b long, size_a long, size_b long, wide_a array<long>, wide_b array<long>"


def random_set(g, size):
    return np.unique(g.integers(0, 2**63, size).astype(np.uint64))


def bits_of(wide):
    return np.unpackbits(wide.view(np.uint8))


def pairs_of(spark, sets):
    rows = [(i, i, len(a), len(b), jaccard_join.wide_parity(a).tolist(), jaccard_join.wide_parity(b).tolist()) for i, (a, b) in enumerate(sets)]
    return spark.createDataFrame(rows, PAIRS)


def test_long_parity_bits():
    g = np.random.default_rng(3)
    assert jaccard_join.wide_parity(random_set(g, 512)) is None
    for size in (513, 1024, 1025, 7000):
        a = random_set(g, size)
        wide = jaccard_join.wide_parity(a)
        assert size <= 64 * len(wide) < 2 * size
        b = np.concatenate([a[size // 20 :], random_set(g, size // 20 + 40)])
        other = jaccard_join.wide_parity(np.unique(b))
        n = min(len(wide), len(other))
        one, two = (w if len(w) == n else w[:n] ^ w[n:] for w in (wide, other))
        assert 0 < (bits_of(one) != bits_of(two)).sum() <= len(np.setxor1d(a, b))


def test_long_parity_bits_drop_no_link(spark):
    g = np.random.default_rng(4)
    sets, linked = [], []
    for _ in range(400):
        size = int(g.integers(700, 3000))
        a = random_set(g, size)
        b = np.unique(np.concatenate([a[int(g.integers(0, size // 6)) :], random_set(g, int(g.integers(1, size // 6)))]))
        both = len(np.intersect1d(a, b))
        sets.append((a, b) if g.random() < 0.5 else (b, a))
        linked.append(100 * both >= 80 * (len(a) + len(b) - both))
    kept = {r.a for r in pairs_of(spark, sets).where(jaccard_join._wide_may_link(80)).collect()}
    assert sum(linked) > 100
    assert {i for i, x in enumerate(linked) if x} <= kept
    lengths = [(len(jaccard_join.wide_parity(a)), len(jaccard_join.wide_parity(b))) for a, b in sets]
    assert any(x != y for x, y in lengths)


def test_long_parity_bits_drop_unlike_sets(spark):
    g = np.random.default_rng(5)
    sets = []
    for _ in range(200):
        size = int(g.integers(1200, 6000))
        a = random_set(g, size)
        sets.append((a, np.unique(np.concatenate([a[: size // 2], random_set(g, size // 2)]))))  # Jaccard of a third
    assert pairs_of(spark, sets).where(jaccard_join._wide_may_link(80)).count() == 0
    few = random_set(g, 600)
    assert pairs_of(spark, [(few, random_set(g, 2400))]).where(jaccard_join._wide_may_link(20)).count() == 1  # not compared


def test_whole_sets_only_of_near_pairs(spark, monkeypatch):
    g = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in g.integers(0, 10**9, n)]
    line = word(1200)
    rows = [(i, " ".join([*word(900), *line, *word(900)])) for i in range(14)]
    rows += [(100 + i, f"{text} {' '.join(word(9))}") for i, text in rows[:2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fetched = {"candidates": 0, "sets": 0}
    plain = common.saved

    def counted(df, label):
        out = plain(df, label)
        if label in fetched:
            fetched[label] += out.count()
        return out

    monkeypatch.setattr(jaccard_join, "saved", counted)
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs).select("doc_id").collect()) == list(range(14))
    assert fetched["candidates"] > 13  # the unlike ones did meet
    assert fetched["sets"] == 4


def test_signatures_of_single_rows_are_not_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 40 if i < 60 else i, [i % 40 if i < 60 else i] * 3) for i in range(200)], "id long, sigs array<long>").repartition(3)
    rows = common.saved(rows, "test-rows")
    several = common.saved(rows.groupBy("id").count().where("count > 1").select("id"), "test-several")
    expected = sorted((i, [i] * 3) for i in {*range(40), *range(60, 200)})
    once = jaccard_join._once(rows, several)
    assert sorted((r.id, r.sigs) for r in once.collect()) == expected
    assert once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    assert "BroadcastHashJoin" in once._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", 5)
    assert sorted((r.id, r.sigs) for r in jaccard_join._once(rows, several).collect()) == expected


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_shuffle_files_go_when_a_table_is_saved(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(name), shuffle_files(spark)
    table = common.saved(spark.range(10_000).selectExpr("id % 1000 as x").groupBy("x").count(), "test-counts")
    for _ in range(50):  # they go in the background
        if left := shuffle_files(spark) - there:
            time.sleep(0.1)
    assert not left
    assert table.count() == 1000
    assert spark.conf.get(name) == before


def test_each_signature_is_dealt_out_in_one_pass(spark):
    g = np.random.default_rng(7)
    rows = [(i, [int(x) for x in g.integers(-40, 40, 6)]) for i in range(60)]
    filled = common.saved(spark.createDataFrame([*rows, rows[5]], "id long, sigs array<long>"), "test-rows")
    several = filled.groupBy("id").count().where("count > 1").select("id")
    got = [[(r.sig, r.id, r.first) for r in jaccard_join._groups(filled, several, k).distinct().collect()] for k in range(jaccard_join.PASSES)]
    ids = {}
    for i, sigs in rows:
        for x in sigs:
            ids.setdefault(x, set()).add(i)
    assert sorted(sum(got, [])) == sorted((x, i, min(own)) for x, own in ids.items() if len(own) > 1 for i in own)
    assert len(got) > 1 and min(map(len, got)) > 0.25 * max(map(len, got))
