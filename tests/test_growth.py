"""Work that must not grow faster than its tables: what is handed on between the steps, and the same results."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import _common, jaccard
from lodestone.operators import aliases, bucket_links, chunking, crawl, gaps, graph_index, knowledge, layout, postings, validation
from lodestone.shared import save


def kept(monkeypatch, module):
    """What ``module`` saves from now on."""
    saved, save = {}, module.save
    monkeypatch.setattr(module, "save", lambda df, label, *more: saved.setdefault(label, save(df, label, *more)))
    return saved


def test_cited_places_are_put_together_once(spark, monkeypatch):
    saved = kept(monkeypatch, knowledge)
    chunks = [("d", i, i // 10, i // 10 + 1, "Wiring > Part EN", f"t{i}") for i in range(40)] + [("e", 0, 5, None, "Part DE", "u"), (None, 0, 1, 1, "Part EN", "n")]
    chunks = spark.createDataFrame(chunks, "doc_id string, chunk_index long, page_from int, page_to int, section_path string, text string")
    cites = [(i, "d", None, " part EN ") for i in range(50)] + [(i, "d", 2, None) for i in range(50, 90)] + [(90, "e", 5, "x"), (91, "e", 6, None), (92, None, None, "part en"), (93, "d", None, None), (0, "e", None, "PART de")]
    found = knowledge.citation_text(chunks, spark.createDataFrame(cites, "cite_id long, doc_id string, page int, section string"))
    section, page = "\n\n".join(f"t{i}" for i in range(40)), "\n\n".join(f"t{i}" for i in range(10, 30))
    want = [(c, section if c < 50 and d == "d" else page if c < 90 and d == "d" else "u" if c in (0, 90) else None) for c, d, _, _ in cites]
    assert sorted(((r["cite_id"], r["text"]) for r in found.collect()), key=str) == sorted(want, key=str)
    assert saved["cited-places"].count() == 4


def test_salted_buckets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bucket_links, "BROADCAST_BUCKETS", 0)
    joins = []
    monkeypatch.setattr(bucket_links, "save", lambda df, label, *more: (joins.append(df._jdf.queryExecution().executedPlan().toString()) if label == "bucket-links" else None, save(df, label, *more))[1])
    nodes = save(spark.range(400).selectExpr("id", "id h", "1L weight", "array(1D, double(id % 100)) v", "2 dim", "0 label"), "nodes")
    posts = save(nodes.selectExpr("label", "dim", "id", "h", "id % 100 bucket"), "posts")
    found = bucket_links.links(nodes, posts, 0.999999)
    assert found.agg(F.sum("links")).first()[0] == 400 * 3
    met = [line for line in joins[0].splitlines() if "Join" in line and "salt" in line]
    assert met and all("SortMergeJoin" in line for line in met)


def test_keys_repeated_for_each_salt_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    keys = save(spark.range(50).selectExpr("if(id = 7, null, id) k", "id * 2 first"), "keys")
    rows = spark.range(400).selectExpr("id", "if(id % 100 = 7, null, id % 100) k")
    for how, n in (("inner", 200), ("left", 400), ("left_semi", 200), ("left_anti", 200)):
        met = _common.join_keys(rows, keys, ["k"], ["id"], how)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert met.count() == n
        if how in ("inner", "left"):
            assert {r["id"]: r["first"] for r in met.collect()} == {i: i % 100 * 2 if i % 100 < 50 else None for i in range(400) if how == "left" or i % 100 < 50}


def test_unlike_sets_that_share_a_frequent_gram_do_not_all_meet(spark, monkeypatch):
    """Of 300 sets around one common member only those that share another of their fronts meet, and the similar ones are found."""
    written, save = {}, jaccard.save

    def grouped(df, label, *more):
        out = save(df, label, *more)
        if label.startswith("open-"):
            written[label] = out.groupBy(*[c for c in ("gram", "front") if c in out.columns]).count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(jaccard, "save", grouped)
    sets = {i: [5, 6, *range(1000 * i + 1000, 1000 * i + 1008)] for i in range(1, 300)}
    sets |= {1000 + i: [5, 6, *range(1000 * i + 1000, 1000 * i + 1007), -i] for i in (100, 200)}  # 9 of 11 in common
    rows = [(f"{i:04d}".encode(), len(x), sorted(x), jaccard.bitmap(np.array(x)).tolist()) for i, x in sets.items()]
    nodes = jaccard.save(spark.createDataFrame(rows, "sig binary, n int, part array<long>, bits array<long>"), "nodes")
    posts = jaccard.shared_posts(nodes.select("sig", "n", F.lit(0).alias("pos"), F.lit(5).cast("long").alias("gram"), "bits"))
    roots = jaccard.linked_components(posts, 80, lambda needed: nodes.select("sig", F.lit(0).alias("fragment"), "part")).collect()
    assert {(bytes(r["node"]), bytes(r["root"])) for r in roots} == {(x, y) for y, z in ((b"0100", b"1100"), (b"0200", b"1200")) for x in (y, z)}
    assert written["open-posts"] >= 301 > jaccard.FREQUENT >= written.get("open-fronts", 301)


def test_gap_vectors_are_written_once_however_many_they_meet(spark, monkeypatch):
    """Counts of words all point one way, so that hashes of them share buckets; here no row is written for what two vectors share."""
    monkeypatch.setattr(gaps, "BLOCK_NUMBERS", 2000, raising=False)
    monkeypatch.setattr(gaps, "ROWS_AT_ONCE", 64, raising=False)
    written, save = [], gaps.save

    def counted(df, label, *more):
        out = save(df, label, *more)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(gaps, "save", counted)
    r = np.random.default_rng(4)
    v = r.poisson(1.0, (500, 16)).astype(float) + 0.0
    v[:, 0] += 3
    v[400:] = v[400] + r.random((100, 16)) / 10  # all alike, all different
    v[7], v[8] = [3.0] + [0.0] * 15, [9.0, 3.0, 3.0, 1.0] + [0.0] * 12  # a cosine of just 0.9
    out = gaps.gap_groups(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, vector array<double>").repartition(3)).collect()
    near = v @ v.T / np.sqrt((v**2).sum(1)[:, None] * (v**2).sum(1)[None, :]) >= 0.9
    assert near[7, 8]
    root = np.arange(500)
    while (new := np.where(near, root[None, :], 500).min(1)).tolist() != root.tolist():
        root = new
    assert {q["id"]: (q["group_id"], q["asked"]) for q in out} == {i: (int(root[i]), int((root == root[i]).sum())) for i in range(500)}
    nodes = dict(written)["gap-nodes"]
    assert [n for label, n in written if label != "gap-links" and n > nodes] == [] and sum(n for _, n in written) < 20 * nodes


def test_only_products_among_the_best_are_sorted(monkeypatch):
    r = np.random.default_rng(3)
    q, u = r.integers(-3, 4, (50, 8)) / 10, r.integers(-3, 4, (3000, 8)) / 10
    ids, sorted_rows = r.permutation(3000), []
    lexsort = np.lexsort
    monkeypatch.setattr(graph_index.np, "lexsort", lambda keys, *more: (sorted_rows.append(len(keys[0])), lexsort(keys, *more))[1])
    best = np.full((50, 7), -np.inf), np.full((50, 7), -1, np.int64)
    for at in [0, 3, 500, 1000]:
        end = {0: 3, 3: 500, 500: 1000, 1000: 3000}[at]
        best = graph_index._merge(best, q, u[at:end], ids[at:end], 7)
    want = [lexsort((ids, -s))[:7] for s in np.round(q @ u.T, 6)]
    assert best[1].tolist() == [ids[w].tolist() for w in want]
    assert np.allclose(best[0], [np.round(q[i] @ u[w].T, 6) for i, w in enumerate(want)]) and sum(sorted_rows) < 50 * 3000 / 5


def test_rules_deal_the_sheet_once(spark):
    names = "entry_id string, org_id string, sheet_version int, deleted_at timestamp, year int, make string, model string, start_type string, circuit string, cell_kind string, cell_raw string, connector_pins int, pin int, validation_notes map<string,string>"
    row = lambda i, make, year, circuit, pin, raw: (i, "o", 1, None, year, make, "M", None, circuit, "inline", raw, 9, pin, None)
    rows = [row(f"a{y}", "Kia", 2000 + y, "A", y, f"BCM 1, pin {y}") for y in range(1, 4)] + [row("b", "KIA", 2001, "B", 7, "bcm 1, PIN 1"), row("c", "kia", 2004, "A", 4, "BCM 1, pin 4")]
    out = validation.validate(spark.createDataFrame(rows, names), "o", 1)[0]
    assert {r["entry_id"]: sorted(r["validation_notes"]) for r in out.collect()} == {"a1": ["V2", "V4"], "a2": ["V2"], "a3": ["V2"], "b": ["V4"], "c": []}
    constant = out.sparkSession.createDataFrame(rows, names).withColumn("model", F.lit("M"))
    for found in (out, validation.validate(constant, "o", 1)[0]):
        assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_names_meet_by_the_rarest_trigrams_of_their_length(spark):
    names = [(i, f"Supplier#{i:09d}") for i in range(0, 3000)]
    posts = aliases.name_postings(spark.createDataFrame(names, "id long, name string"))
    asked = spark.createDataFrame([(i, n.replace("#0", "")) for i, n in names[::50]], "asked_id long, asked string")
    found = aliases.similar_names(posts, asked, 0.7)
    grams = lambda s: {("  " + s.lower() + " ")[i : i + 3] for i in range(len(s) + 1)}
    own = [(i, grams(n)) for i, n in names]
    want = [(a["asked_id"], i) for a in asked.collect() for i, g in own if (q := grams(a["asked"])) and len(q & g) / len(q | g) >= 0.7]
    assert sorted((r["asked_id"], r["id"]) for r in found.collect()) == sorted(want)
    assert re.search(r"Join \[gram#\d+, size#\d+\], \[gram#\d+, size#\d+\], Inner", found._jdf.queryExecution().sparkPlan().toString())


def test_postings_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "TOKENS_AT_ONCE", 4)
    plans = {}
    monkeypatch.setattr(postings, "save", lambda df, label, *more: (plans.__setitem__(label, df._jdf.queryExecution().executedPlan().toString()), save(df, label, *more))[1])
    texts = [(1, "Valve valves, the VALVE and a pump"), (2, None), (3, ""), (4, "the and"), (5, "pumps pump valve " * 5), (6, "x9 pump")]
    rows = {}
    for i, text in texts:
        for place, token in enumerate(re.findall("[a-z0-9]+", (text or "").lower())):
            if token not in ("the", "and", "a"):
                rows.setdefault((token.removesuffix("s").replace("valve", "valv"), i), []).append(place)
    for most in (postings.BROADCAST_STEMS, 0):
        monkeypatch.setattr(postings, "BROADCAST_STEMS", most)
        index = postings.index_texts(spark.createDataFrame(texts, "id long, text string"))
        assert {(r["stem"], r["id"]): r["places"] for r in index.segments[0].collect()} == rows
        if most:
            assert set(plans) == {"token-stems", "postings"} and len(re.findall(r"\bExchange ", plans["postings"])) == 1


def test_chunks_are_dealt_by_document(spark, monkeypatch):
    saved = kept(monkeypatch, chunking)
    names = "doc_id long, title string, pos int, type string, text string, level int, items array<struct<marker:string,text:string>>, ordered boolean, callout_kind string, page int, page_end int"
    item = [("1.", "turn it")]
    rows = [(1, "T", 0, "heading", "Head", 1, None, None, None, 0, None), (1, "T", 1, "callout", "hot", None, None, None, "warning", 0, None), (1, "T", 2, "list", None, None, item, True, None, 1, None), (1, "T", 3, "callout", "cold", None, None, None, None, 2, None)]
    rows += [(1, "T", 4, "table", "a | b\n" + "c | d\n" * 900, None, None, None, None, 3, 4), (2, "U", 0, "paragraph", "word " * 1000, None, None, None, None, None, None), (2, "U", 1, "list", None, None, item * 900, False, None, 1, None)]
    out = chunking.chunk_blocks(spark.createDataFrame(rows, names))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert set(saved) == {"blocks"} and plan.count("FileScan parquet") == 4
    # Beside what Spark deals by document itself, children are dealt once, by document.
    planned = re.findall(r"\bExchange hashpartitioning\((.*?)\d+L?, \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert planned and set(planned) == {"doc_id#"} and len(planned) <= 5
    found = out.orderBy("doc_id", "chunk_index").collect()
    for doc in (1, 2):
        assert [r["chunk_index"] for r in found if r["doc_id"] == doc] == list(range(sum(r["doc_id"] == doc for r in found)))
    steps = [r for r in found if r["kind"] == "procedure"]
    assert [(r["text"], r["has_warning"], r["step_count"], r["page_from"], r["page_to"]) for r in steps] == [("T › Head\nWARNING: hot\n\n1. turn it", True, 1, 0, 1)]
    assert {r["part"] for r in found if r["kind"] == "list"} == {f"{i}/4" for i in (1, 2, 3, 4)} and sum(r["kind"] == "table" for r in found) == 3


def exchanges(df):
    """Shuffles and sorts of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange ", plan)), len(re.findall(r"\bSort ", plan))


def test_lines_are_made_of_one_order(spark):
    items = [(1, "b", 20.0, 100.0, 5.0, 10.0, True), (1, "a", 0.0, 101.0, 10.0, 10.0, True), (1, "c", 60.0, 100.0, 5.0, 9.0, False), (1, "dd", 0.0, 80.0, 5.0, None, None), (1, None, 5.0, 80.0, 5.0, 8.0, True), (2, "e", 1.0, 1.0, 1.0, 8.04, True), (2, "f", 2.0, 1.0, 1.0, 8.0, True)]
    out = layout.lines(spark.createDataFrame(items, "page long, text string, x double, y double, width double, size double, bold boolean"), ["page"])
    rows = [tuple(r[c] for c in ("page", "line", "text", "x", "y", "size", "chars", "bold")) for r in out.orderBy("page", "line").collect()]
    assert rows == [(1, 1, "a b | c", 0.0, 101.0, 10.0, 3, False), (1, 2, "dd", 0.0, 80.0, None, 2, True), (2, 1, "ef", 1.0, 1.0, 8.0, 2, True)]
    assert exchanges(out) == (1, 1)


def test_blocks_put_lines_in_order_twice(spark):
    kinds = [("heading", "caps")] * 2 + [("text", None)] + [("heading", "size")] * 3 + [("callout", None), ("item", "num"), ("text", None), ("caption", None), ("heading", "size"), ("heading", "size")]
    rows = [(d, i, 0, "0", 700.0 - 14 * i, 9.0, f"text number {i} goes on and on", t, b, False, 1 if b == "num" else None, f"text number {i}", None) for d in (1, 2) for i, (t, b) in enumerate(kinds)]
    found = spark.createDataFrame(rows, "doc_id long, pos int, page int, region string, y double, size double, text string, type string, basis string, bold boolean, number int, rest string, callout_kind string")
    out = layout.demote(found, 14.0)
    assert [r["type"] for r in out.where("doc_id = 1").orderBy("pos").collect()] == ["text", "heading", "text", "text", "text", "text", "callout", "item", "text", "caption", "heading", "heading"]
    assert exchanges(out) == (1, 1)
    made = layout.blocks(out, 14.0)
    assert [(r["pos"], r["type"]) for r in made.where("doc_id = 2").orderBy("pos").collect()] == [(0, "paragraph"), (1, "heading"), (2, "paragraph"), (6, "callout"), (9, "caption"), (10, "heading")]
    assert exchanges(made)[0] == 1


def test_regions_are_dealt_once_a_round(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(layout, "save", lambda df, label, *more: (plans.append(exchanges(df)[0]), save(df, label, *more))[1])
    items = [(p, 100.0 * (i % 2), 20.0 * i, 30.0, 10.0) for p in (1, None) for i in range(8)]
    out = layout.regions(spark.createDataFrame(items, "page long, x double, y double, width double, size double"), page_width=F.lit(130.0))
    assert {(r["page"], r["region"], r["count"]) for r in out.groupBy("page", "region").count().collect()} == {(1, "0", 4), (1, "1", 4), (None, "", 8)}
    assert set(plans) == {1}


def test_a_run_of_the_crawl_is_written_once(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(crawl, "save", lambda df, label, *more: saved.append((label, save(df, label, *more))) or saved[-1][1])
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    keys = table([("A", "1", "m", str(i), "k") for i in range(3)], "make year model recnum key_type")
    pages = spark.createDataFrame([("A", "1", "m", "0", 0, None), ("A", "1", "m", "1", 3, None), ("A", "1", "m", "2", None, "late")], "make string, year string, model string, recnum string, wires int, problem string")
    levels = table([("A",)], "make"), table([("A", "1")], "make year"), table([("A", "1", "m")], "make year model"), keys
    marks, vehicles = crawl.resume(*levels, pages, table([], "make year model state"), table([], "make year model recnum key_type status problem"))
    assert [(n, df.count()) for n, df in saved] == [("fetched", 3)] and marks.count() == 0
    assert sorted((r["recnum"], r["status"], r["problem"]) for r in vehicles.collect()) == [("0", "no wire table", None), ("1", "ok", None), ("2", "error", "late")]
    fixed = pages.withColumns({"wires": F.lit(3), "problem": F.lit(None).cast("string")})
    marks, vehicles = crawl.resume(*levels, fixed, marks, vehicles)
    assert [(r["make"], r["state"]) for r in marks.collect()] == [("A", "done")]
    assert sorted((r["recnum"], r["status"]) for r in vehicles.collect()) == [("0", "no wire table"), ("1", "ok"), ("2", "ok")]
