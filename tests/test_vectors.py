"""The graph index, groups of questions, misspelt names and the inverted index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import aliases, bucket_links, components, gaps, graph_index, knowledge, postings


def cloud(n, dim, seed=1, clusters=0):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    if clusters:
        v = v * 0.3 + r.standard_normal((clusters, dim))[r.integers(0, clusters, n)]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("clusters", [0, 20])
def test_graph_search_finds_the_nearest(clusters):
    u = cloud(4000, 32, 2, clusters)
    links = graph_index.graph(u)
    assert links.shape == (4000, 48) and (links < 4000).all()
    q = cloud(200, 32, 3) if not clusters else u[:200] + 0.05 * cloud(200, 32, 4)
    found, score = graph_index.search(u, links, q, 20)
    exact = np.argsort(-(q @ u.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), exact.tolist(), strict=True)]) > 0.95
    assert np.allclose(score, np.take_along_axis(q @ u.T, found, 1))
    assert all(len(set(x)) == 20 for x in found.tolist())


def test_index_over_shards_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "QUESTIONS_AT_ONCE", 40)
    u = cloud(900, 16, 5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(u)]
    rows += [rows[3], (1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (None, rows[0][1]), (1004, [1.0, 2.0]), (1005, [None] * 16)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = table.where("id % 10 = 0 OR id IS NULL")
    exact = graph_index.nearest_exactly(table, asked, 10).collect()
    want = []
    for i in range(0, 900, 10):
        s = np.round(u @ u[i], 6)
        want += [(i, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(900), -s))[:10])]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in exact if r["query_id"] < 900) == sorted(want)
    assert [(r["query_id"], r["id"]) for r in exact if r["query_id"] >= 900] == [] and len(exact) == len(want)
    index = graph_index.build(table, shard_rows=200)
    assert index.count() > 4 and sum(len(r["ids"]) for r in index.collect()) == 901
    near = graph_index.nearest(index, asked, 10)
    out = graph_index.recall(graph_index.nearest_exactly(table, asked, 10), near, 10).collect()
    assert len(out) == 90 and np.mean([r["recall"] for r in out]) > 0.97
    alone = graph_index.nearest(index, spark.createDataFrame([(7, [2.0, 4.0])], "id long, vector array<double>"), 10).collect()
    assert [(r["id"], r["similarity"], r["rank"]) for r in alone] == [(1004, 1.0, 1)]
    empty = table.limit(0)
    assert graph_index.nearest(graph_index.build(empty), empty).collect() == [] == graph_index.nearest_exactly(empty, table).collect()


def test_each_shard_has_a_task(spark, monkeypatch):
    """Graphs are built one a task, whatever few bytes they are, and one graph is searched by several tasks with the same result."""
    u = cloud(900, 16, 6)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(u)], "id long, vector array<double>")
    index = graph_index.build(table, shard_rows=150)
    assert index.count() > 4 and len(index.inputFiles()) == index.count()
    one = graph_index.build(table, shard_rows=900)
    tasks, ran = [], type(one).mapInArrow
    monkeypatch.setattr(type(one), "mapInArrow", lambda df, *more: (tasks.append(df.rdd.getNumPartitions()), ran(df, *more))[1])
    near = graph_index.nearest(one, table, 10)
    monkeypatch.undo()
    assert tasks == [4]
    assert graph_index.recall(graph_index.nearest_exactly(table, table, 10), near, 10).agg(F.avg("recall")).first()[0] > 0.97


@pytest.mark.parametrize("small", [False, True])
def test_gap_groups(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(bucket_links, "BLOCK", 7)
        monkeypatch.setattr(bucket_links, "BUNDLE", 20)
        monkeypatch.setattr(bucket_links, "BROADCAST_BUCKETS", 0)
        monkeypatch.setattr(components, "EDGES_AT_ONCE", 0)
    r = np.random.default_rng(8)
    base = cloud(40, 12, 9)
    rows = [(i, [float(x) for x in base[i % 40] + 0.12 * r.standard_normal(12)]) for i in range(300)] + [(i, [float(x) for x in base[0]]) for i in range(300, 340)]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [None] * 12), (None, rows[0][1]), (404, [float("inf")] * 12), rows[5]]
    part = {i: np.array(v) for i, v in rows if i is not None and i < 400}
    root = {i: i for i in part}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in part.items():
        for j, y in part.items():
            if i < j and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    size = {}
    for i in part:
        size[top(i)] = size.get(top(i), 0) + 1
    want = [(str(i), str(top(i)), size[top(i)]) if i in part else (str(i), str(i), 1) for i, _ in rows]
    out = gaps.gap_groups(spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)).collect()
    assert sorted((str(q["id"]), str(q["group_id"]), q["asked"]) for q in out) == sorted(want)
    assert gaps.gap_groups(spark.createDataFrame([], "id long, vector array<double>")).collect() == []


def test_similar_names(spark):
    names = [(i, n) for i, n in enumerate(["Acura RDX", "acura rdx", "Acura TLX", "Honda Civic", "Honda", "", None, "Civic", "Ford F-150 Lariat", "é"])]
    asked = [(0, "Acura RDXX"), (1, "hnda civic"), (2, ""), (3, None), (4, "Zzz"), (5, "E")]
    posts = aliases.name_postings(spark.createDataFrame(names, "id long, name string"))
    got = aliases.similar_names(posts, spark.createDataFrame(asked, "asked_id long, asked string"), 0.4).collect()
    grams = lambda s: {("  " + s.lower() + " ")[i : i + 3] for i in range(len(s) + 1)}
    want = [(a, i, round(len(grams(x) & grams(n)) / len(grams(x) | grams(n)), 6)) for a, x in asked if x is not None for i, n in names if n is not None]
    assert sorted((r["asked_id"], r["id"], r["score"]) for r in got) == sorted(w for w in want if w[2] >= 0.4)


def test_postings_take_further_texts(spark):
    texts = [(1, "Relay wires and relay wiring"), (2, "wired to the relay. Ignition wire"), (3, None), (4, ""), (5, "the of and"), (6, "RELAY " * 500)]
    table = spark.createDataFrame(texts, "id long, text string")
    index = postings.index_texts(table.where("id <= 3")).extended(table.where("id > 3"))
    find = lambda q, live=table: [(r["id"], r["hits"]) for r in knowledge.text_search(index, live, knowledge.parse_question(q)).orderBy("rank").collect()]
    assert find("relay") == [(6, 500), (1, 2), (2, 1)] and find("relay", table.where("id < 5")) == [(1, 2), (2, 1)]
    assert find('"relay wire"') == [(1, 2)] and find("the") == [] and find("") == []
    assert find("-relay") == [(3, 0), (4, 0), (5, 0)] and find("ignition -relay") == [(2, 1), (3, 0), (4, 0), (5, 0)]
    plan = index.of(["relay"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stem" in plan or "EqualTo(stem,relay)" in plan
