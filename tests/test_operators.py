"""Operators that no table of the shared data exercises, on fixtures."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.files import retries
from lodestone.operators import crawl, knowledge, layout, listing, merging, publication, vocabulary
from lodestone.operators.chunking import FIGURE_MARK, Sizes, chunk_blocks, estimate, fill, parents, pieces, split_prose
from lodestone.operators.conversation import procedures, steps
from lodestone.operators.validation import lookup, validate
from lodestone.sources import catalog
from lodestone.sources.frames import answer_text, parse_frames
from lodestone.sources.wires import circuit, parse_wires
from lodestone.streaming.jobs import cancel, next_state
from lodestone.streaming.leases import stale_leases

ENTRY = "entry_id string, org_id string, sheet_version int, year int, make string, model string, circuit string, cell_kind string, cell_raw string, wire_colour string, connector_pins int, pin int, start_type string, is_live boolean, deleted_at timestamp, validation_notes map<string,string>"


def entry(i, year, circ, raw, pins, pin, notes=None, model="RDX", start=None):
    return (i, "o", 1, year, "Acura", model, circ, "inline", raw, "red", pins, pin, start, True, None, notes)


def drag_fill():
    out = [entry(f"a{y}", y, "12v", f"BCM, pin {y - 2005}", 7, y - 2005) for y in range(2008, 2013)]
    return out + [entry(f"b{y}", y, "ignition", f"IGN, pin {y - 2002}", 7, y - 2002) for y in range(2008, 2013)]


def test_drag_fill(spark):
    out, report = validate(spark.createDataFrame(drag_fill(), ENTRY), "o", 1)
    assert {r["rule"][:2] if r["rule"][0] == "V" else r["rule"]: r["affected"] for r in report.collect()} == {"V1": 3, "V2": 10, "V4": 0, "V5": 0, "state: quarantined": 3, "state: flagged": 7}
    again, _ = validate(out.drop("validation_state"), "o", 1)
    assert sorted(map(str, again.select(*out.columns).collect())) == sorted(map(str, out.collect()))


def test_rules_and_foreign_notes(spark):
    rows = [entry("x", 2008, "12v", "Same", 9, None), entry("y", 2008, "ignition", "SAME", 9, None), entry("z", 2009, "12v", "one", 9, None, {"V6": "low"}), entry("p", 2010, "12v", "one", 9, None), entry("q", 2010, "12v", "two", 9, None), entry("r", 2011, "12v", "fine", 9, None)]
    rows += [entry(f"s{y}", y, "12v", f"w, pin {p}", 9, p, model="TL") for y, p in ((2008, 1), (2009, 2), (2011, 3))]
    found = {r["entry_id"]: (r["validation_state"], sorted(r["validation_notes"])) for r in validate(spark.createDataFrame(rows, ENTRY), "o", 1)[0].collect()}
    assert found["x"] == found["y"] == ("flagged", ["V4"]) and found["z"] == ("flagged", ["V6"])
    assert found["p"] == found["q"] == ("quarantined", ["V5"]) and found["r"] == ("ok", [])
    assert all(found[f"s{y}"][0] == "ok" for y in (2008, 2009, 2011))
    # Start types are vehicles of their own; other versions and deleted rows take no part.
    apart = [entry("x", 2008, "12v", "same", 9, None), entry("y", 2008, "ignition", "same", 9, None, start="key"), entry("z", 2008, "12v", "other", 9, None, start="key")]
    other = [(i, "o", 2, *r) for i, _, _, *r in [entry("w", 2008, "ignition", "same", 9, None)]]
    out = validate(spark.createDataFrame(apart + other, ENTRY), "o", 1)[0].collect()
    assert {r["entry_id"]: r["validation_state"] for r in out} == {"x": "ok", "y": "ok", "z": "ok", "w": None}


def test_lookup_masks(spark):
    out = validate(spark.createDataFrame(drag_fill() + [entry("k", 2012, "12v", "free", 9, 1, start="key")], ENTRY), "o", 1)[0]
    got = lookup(out, "acura", "rdx", 2012, "ignition").collect()
    assert [(r["entry_id"], r["pin"], r["cell_raw"]) for r in got] == [("b2012", None, None)]
    assert lookup(out, "acura", "rdx", 2013).collect() == [] and [r["start_type"] for r in lookup(out, "ACURA", "RDX", 2012, "12v").collect()] == [None, "key"]


BLOCK = "doc_id string, title string, pos int, type string, text string, level int, items array<struct<marker:string,text:string>>, ordered boolean, callout_kind string, page int, page_end int"


def blocks(rows):
    return [("d", "Guide", i, t, text, level, items, bool(items), "warning" if t == "callout" else None, page, None) for i, (t, text, level, items, page) in enumerate(rows)]


def test_filling():
    assert fill([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3] and fill([], 10) == [] and fill([5, 5], 10, head=5) == [0, 1]
    assert parents([100, 60, 10, 1300, 5], [True, False, True, False, True], 150, 1200) == [0, 0, 1, 2, 3]
    s = Sizes()
    assert pieces(["fill", "fill", "fill", "table", "fill", "part", "fill"], [200, 40, 30, 9, 100, 300, 10], s) == [0, 0, 0, 1, 2, 3, 3]
    assert Sizes.of({"child_target": "200", "child_max": "many", "overlap": -1, "other": 3}) == (Sizes(child_target=200), ["child_max", "overlap"])


def test_chunks(spark):
    item = lambda i: (f"{i}.", f"step {i} " + "turn the screw " * 6)
    rows = [("heading", "A", 1, None, 1), ("callout", "hot", None, None, 1), ("list", None, None, [item(i) for i in range(1, 41)], 2), ("callout", "then more prose", None, None, 2), ("paragraph", "after", None, None, 2), ("heading", "B", 2, None, 3)]
    rows += [("paragraph", "Some words go here. " * 120, None, None, 3), ("table", "h1 | h2\n" + "\n".join(f"r{i} | " + "x" * 60 for i in range(80)), None, None, 4), ("figure", "a pump", None, None, 5), ("figure", None, None, None, 5), ("other", "kept anyway", None, None, None), ("list", None, None, [item(1), item(2)], 6), ("callout", "last", None, None, 7)]
    out = chunk_blocks(spark.createDataFrame(blocks(rows), BLOCK)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in out] == list(range(len(out)))
    lists = [r for r in out if r["kind"] == "procedure"]
    long, last = lists[:-1], lists[-1]
    head = "Guide › A\nWARNING: hot\n\n"
    assert len(long) > 1 and all(r["text"].startswith(head) and r["has_warning"] and estimate(r["text"]) <= Sizes.procedure_max + 20 for r in long)
    said = "\n".join(r["text"] for r in long)
    assert all(f"step {i} " in said for i in range(1, 41)) and [r["part"] for r in long] == [f"{k}/{len(long)}" for k in range(1, len(long) + 1)]
    assert last["part"] is None and last["text"].endswith("\n\nWARNING: last") and (last["page_from"], last["page_to"], last["step_count"]) == (6, 7, 2)
    alone = [r for r in out if r["kind"] == "callout"]
    assert [r["text"] for r in alone] == ["Guide › A\nWARNING: then more prose"], "prose follows, so it belongs to no list"
    tables = [r for r in out if r["kind"] == "table"]
    assert len(tables) > 1 and all(r["text"].startswith("Guide › A > B\nh1 | h2") for r in tables)
    assert [r["text"] for r in out if r["kind"] == "figure"] == [f"Guide › A > B\n{FIGURE_MARK}\na pump"] and any("kept anyway" in r["text"] for r in out if r["kind"] == "prose")
    tops = [r for r in out if r["is_parent"]]
    assert tops[0]["text"].startswith("Guide › A\n\nA\n\nWARNING: hot") and all(r["parent_index"] is None for r in tops)
    index = {r["chunk_index"] for r in tops}
    assert all(r["parent_index"] in index and r["parent_index"] < r["chunk_index"] for r in out if not r["is_parent"])


def test_split_prose():
    text = "word " * 2000
    parts = split_prose(text.strip())
    assert all(estimate(p) <= 380 for p in parts) and len(parts) > 5 and split_prose("short") == ["short"]
    assert "".join(split_prose("x" * 2000 + ". ", overlap=0)).startswith("x" * 2000)


def test_wires(spark):
    cell = lambda t: f'<td class="wires">{t}</td>'
    html = '<table><tr class="title"><td>Power</td></tr><tr class="row1">' + "".join(map(cell, ["Constant +12&nbsp;Volts (2)", "red", "+", "fuse <b>box</b>"])) + '<td><a href="/i/1.jpg">p</a></td></tr><tr class="wirenote"><td>Use both.</td></tr><tr class="row2">' + "".join(map(cell, ["Ignition Interrupt", "blue", "-", "kick"])) + "</tr></table>"
    got = parse_wires(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id long, html string")).withColumn("c", circuit(F.col("function"))).collect()
    assert [(r["ordinal"], r["section"], r["function"], r["location"], r["notes"], r["image_url"], r["c"]) for r in got] == [(1, "Power", "Constant +12 Volts (2)", "fuse box", "Use both.", "/i/1.jpg", "12v"), (2, "Power", "Ignition Interrupt", "kick", None, None, "other")]


def test_frames(spark):
    text = 'data: {"type":"delta","text":"a"}\n\n: ping\n\ndata: {bad\n\ndata: {"type":"odd"}\n\ndata: {"type":"delta","text":"b"}\r\n\r\ndata: {"type":"del'
    events = parse_frames(spark.createDataFrame([("s", text), ("t", None)], "id string, text string"))
    assert [r["text"] for r in answer_text(events, "id").collect()] == ["ab"] and events.count() == 2


def test_steps(spark):
    rows = [(1, "Do this:\n1. Open\n2. Warning: hot\nDone"), (2, "2. Late\n3. Later"), (3, "1. Only"), (4, "1. a\n3. b")]
    assert [(r["id"], r["n"], r["warns"]) for r in steps(spark.createDataFrame(rows, "id int, text string"), "id").orderBy("n").collect()] == [(1, 1, False), (1, 2, True)]


def test_jobs(spark):
    rows = [("claim", "pending", 1), ("done", "running", 1), ("done", "cancelled", 1), ("cancel", "running", 1), ("fail", "running", 2), ("fail", "running", 3), ("done", "pending", 0)]
    got = next_state(spark.createDataFrame(rows, "event string, status string, attempts int")).collect()
    assert [r["next"] for r in got] == ["running", "completed", "cancelled", "cancelled", "pending", "failed", "pending"] and got[4]["wait"] == 60


def test_publish(spark):
    schema = "chunk_id string, doc_id string, version int, is_parent boolean, embedding array<float>, is_live boolean, deleted_at timestamp"
    rows = [("a", "d", 1, False, [1.0], True, None), ("b", "d", 2, True, None, False, None), ("c", "d", 2, False, [1.0], False, None), ("e", "x", 1, False, None, False, None)]
    chunks, docs = spark.createDataFrame(rows, schema), spark.createDataFrame([("d", 2), ("x", 1), ("y", 1)], "doc_id string, version int")
    out = publication.publish_version(chunks, docs, "d", 2, F.current_timestamp())
    live = lambda d: {r["chunk_id"] for r in d.where("is_live").collect()}
    assert live(out) == {"c"} == live(publication.publish_version(out, docs, "d", 2, F.current_timestamp())) and {r["chunk_id"] for r in out.where("deleted_at IS NOT NULL").collect()} == {"a"}
    for doc, version in (("d", 1), ("x", 1), ("y", 1), ("z", 1)):
        with pytest.raises(ValueError, match="version|vector"):
            publication.publish_version(chunks, docs, doc, version, F.current_timestamp())


def test_sheet_without_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        publication.publish_sheet(spark.createDataFrame([], ENTRY), "o", 1, F.current_timestamp())
    with pytest.raises(ValueError, match="status"):
        publication.retire(*[spark.createDataFrame([], "doc_id string, status string, is_live boolean")] * 3, "d", "gone")


def test_clear_unpublished(spark):
    rows = [(1, "d", 1, True), (2, "d", 2, False), (3, "d", 2, True), (4, "e", 2, False)]
    assert sorted(r[0] for r in publication.clear_unpublished(spark.createDataFrame(rows, "id int, doc_id string, version int, is_live boolean"), "d", 2).collect()) == [1, 3, 4]


def test_questions():
    found = knowledge.parse_question('pump or "fuse box" -radio the pump')
    assert found == knowledge.Query(("pump",), (("fuse", "box"),), ("radio",)) and knowledge.parse_question(None) == knowledge.Query(())


def test_cancel(spark):
    jobs = spark.createDataFrame([(1, "a", "running"), (2, "a", "completed"), (3, "b", "pending")], "job_id int, source string, status string")
    assert {r["job_id"]: (r["status"], r["was"]) for r in cancel(jobs, spark.createDataFrame([("a",)], "source string")).collect()} == {1: ("cancelled", "running"), 2: ("completed", None), 3: ("pending", None)}


def test_merge_keeps_or_resets(spark):
    old, new = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "k int, t int, d string"), spark.createDataFrame([(1, 5, None), (2, 6, None), (3, 1, None), (3, 1, None)], "k int, t int, d string")
    out = merging.upsert(old, new.dropDuplicates(["k"]), ["k"], {"d": merging.kept_unless_changed("d", "t")})
    assert sorted(map(tuple, out.collect())) == [(1, 5, "x"), (2, 6, None), (3, 1, None)]
    assert sorted(r["k"] for r in merging.insert_ignore(old, new, ["k"]).collect()) == [1, 2, 3]


ITEM = "doc_id int, page int, text string, x double, y double, width double, size double, bold boolean"


def test_columns_are_read_one_after_the_other(spark):
    left = [(1, 1, f"l{i}", 10.0, 700.0 - 14 * i, 90.0, 10.0, False) for i in range(5)]
    right = [(1, 1, f"r{i}", 200.0, 700.0 - 14 * i, 90.0, 10.0, False) for i in range(5)]
    out = layout.regions(spark.createDataFrame(left + right, ITEM)).collect()
    by_region = {}
    for r in sorted(out, key=lambda r: (r["region"], -r["y"])):
        by_region.setdefault(r["region"], []).append(r["text"])
    assert [by_region[k] for k in sorted(by_region)] == [[f"l{i}" for i in range(5)], [f"r{i}" for i in range(5)]]


def test_lines_and_heads(spark):
    rows = [(1, 1, "Pin", 10.0, 500.0, 20.0, 10.0, True), (1, 1, "3", 33.0, 500.5, 5.0, 10.0, True), (1, 1, "red", 90.0, 500.0, 20.0, 10.0, True), (1, 1, "next", 10.0, 480.0, 20.0, 10.0, False)]
    got = layout.lines(spark.createDataFrame(rows, ITEM), ["doc_id", "page"]).orderBy("line").collect()
    assert [(r["text"], r["bold"]) for r in got] == [("Pin 3 | red", True), ("next", False)]
    pages = spark.createDataFrame([(1, p, 800.0) for p in range(1, 5)], "doc_id int, page int, height double")
    text = [(1, p, f"Manual {p}", 790.0) for p in range(1, 5)] + [(1, 1, "Only here", 790.0), (1, 2, "page 2 of 4", 5.0), (1, 3, "Manual 3", 400.0)]
    kept = layout.without_running_heads(spark.createDataFrame(text, "doc_id int, page int, text string, y double"), pages)
    assert sorted(r["text"] for r in kept.collect()) == ["Manual 3", "Only here"]


def test_lines_to_blocks(spark):
    said = ["INSTALLATION", "Read all of this before you start to work.", "WARNING: hot parts", "keep away from them", "1. Open the box", "and look inside", "2. Close it", "Figure 4 the box", "3. Done", "Pin | Colour", "1 | red", "2.1 Wires", "Some more text about the wires here", "of the second kind."]
    y, rows = 700.0, []
    for i, t in enumerate(said):
        y -= 40 if t in ("Pin | Colour", "2.1 Wires", "1. Open the box") else 14
        rows.append((1, i, 1, "0", y, 10.0, t, False))
    found = spark.createDataFrame(rows, "doc_id int, pos int, page int, region string, y double, size double, text string, bold boolean")
    kinds = layout.demote(layout.classify(found, F.lit(10.0), F.lit(0.1)), 14.0)
    got = layout.blocks(kinds, 14.0).orderBy("pos").collect()
    assert [r["type"] for r in got] == ["heading", "paragraph", "callout", "list", "caption", "table", "heading", "paragraph"]
    assert got[2]["text"] == "hot parts keep away from them" and got[2]["callout_kind"] == "warning"
    assert [(i["marker"], i["text"]) for i in got[3]["items"]] == [("1.", "Open the box and look inside"), ("2.", "Close it"), ("3.", "Done")] and got[3]["ordered"]
    assert got[5]["text"] == "Pin | Colour\n1 | red" and got[6]["level"] == 2 and got[7]["text"].endswith("of the second kind.")


def test_retries(spark):
    rows = [(408, None, True, True), (429, None, True, True), (500, "AbortError", True, True), (599, None, True, True), (600, None, False, False), (404, "ETIMEDOUT", False, False), (None, "AbortError", True, True), (None, "EAI_AGAIN", True, True), (None, "ENOTFOUND", False, True), (None, "EPIPE", False, True), (None, None, False, True)]
    out = spark.createDataFrame(rows, "status int, code string, call boolean, worker boolean").select("call", "worker", retries(F.col("status"), F.col("code")).alias("a"), retries(F.col("status"), F.col("code"), True).alias("b")).collect()
    assert all(r["a"] == r["call"] and r["b"] == r["worker"] for r in out)


def read_by_hand(items):
    """The regions of one page's items (text, x, y, width, size) in order, by the rule as it is stated."""
    wide = max(i[1] + i[3] for i in items) - min(i[1] for i in items)

    def gaps(spans, least):
        spans, found = sorted(spans), []
        reach = spans[0][1]
        for start, end in spans[1:]:
            if start - reach >= least:
                found.append(((reach + start) / 2, start - reach))
            reach = max(reach, end)
        return found

    def cut(own):
        if len(own) < 6:
            return [own]
        beside = lambda at: sum(i[1] + i[3] / 2 < at for i in own)
        across = [g for g in gaps([(i[1], i[1] + i[3]) for i in own], max(12, wide * 0.04)) if 3 <= beside(g[0]) <= len(own) - 3]
        if across:
            at = max(across, key=lambda g: (g[1], -g[0]))[0]
            return cut([i for i in own if i[1] + i[3] / 2 < at]) + cut([i for i in own if i[1] + i[3] / 2 >= at])
        down = gaps([(i[2] - i[4] / 4, i[2] + i[4]) for i in own], max(4, sorted(i[4] for i in own)[len(own) // 2] * 1.5))
        if down:
            at = max(down, key=lambda g: (g[1], -g[0]))[0]
            return cut([i for i in own if i[2] >= at]) + cut([i for i in own if i[2] < at])
        return [own]

    return cut(items)


def test_reading_order_goes_on(spark):
    """Columns inside bands inside columns, deeper than a few cuts; pages that can't be cut stay whole."""
    items, n = [], 0

    def place(x, y, wide, depth):
        nonlocal n
        for i in range(3):
            items.append((1, 1, f"{n:03d}", x, y - 12.0 * i, wide if depth else wide * 0.9, 10.0 + n % 3, False))
            n += 1
        if depth:
            # A head over two columns that each go on so.
            for k in range(2):
                place(x + k * wide / 2, y - 70.0 - depth, wide / 2 - 90 * k - 90, depth - 1)

    place(0.0, 4000.0, 2200.0, 4)
    few = [(2, 1, "a", 0.0, 10.0, 5.0, 10.0, False), (2, 1, "b", 500.0, 10.0, 5.0, 10.0, False)]
    out = layout.regions(spark.createDataFrame(items + few, ITEM), ["doc_id", "page"]).collect()
    got = {}
    for r in out:
        got.setdefault((r["doc_id"], r["region"]), set()).add(r["text"])
    want = [{i[0] for i in region} for region in read_by_hand([(t, x, y, w, size) for _, _, t, x, y, w, size, _ in items])]
    assert [got[k] for k in sorted(got) if k[0] == 1] == want and got[2, ""] == {"a", "b"}
    assert len(want) > 8 and max(len(k[1]) for k in got) > 4
    assert layout.regions(spark.createDataFrame([], ITEM)).collect() == []


def test_procedures(spark):
    texts = {
        "steps": "Do it like this:\r\n\n\n\n1. Open the box (Page 7).\nand look inside\n2) Warning: hot (Section: Power, a)\n\nDone , as said  (Pages 7, 8).\nReally",
        "late": "1. a\n2. b\n\nso\n3. c", "one": "1. a\nb", "second": "2. a\n3. b", "bare": "1. a\n2. b", "text": "no steps", "empty": "", "null": None,
    }
    rows = [(k, t, ["c"] if k in ("bare", "null") else None) for k, t in texts.items()]
    out = procedures(spark.createDataFrame(rows, "k string, text string, sources array<string>"), "k", sources="sources").orderBy("k", "pos").collect()
    of = lambda k: [(r["n"], r["text"], r["warns"], r["with_sources"]) for r in out if r["k"] == k]
    assert of("steps") == [(0, "Do it like this:", False, False), (1, "Open the box. and look inside", False, False), (2, "Warning: hot", True, False), (0, "Done, as said.\nReally", False, False)]
    assert of("bare") == [(1, "a", False, False), (2, "b", False, False), (0, "", False, True)]
    for k in ("late", "one", "second", "text", "empty", "null"):
        assert of(k) == [(1, texts[k], False, k == "null")]


def test_procedures_are_shuffled_once(spark):
    """One exchange, whatever becomes of an answer; texts that stay are as written; answers of one key, or of none, are apart."""
    rows = [("a", "x\r\n\r\r\ny\r", ["c"]), ("a", "1. p\r\n2. q", None), ("a", "1. p\r\n2. q", None), (None, "u\n", None), (None, "v", ["c"]), (None, None, None)]
    out = procedures(spark.createDataFrame(rows, "k string, text string, sources array<string>"), "k", sources="sources")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = sorted(map(str, ((r["k"], r["pos"], r["text"], r["with_sources"]) for r in out.collect())))
    want = [("a", 0, "x\r\n\r\r\ny\r", True), ("a", 0, "p", False), ("a", 1, "q", False), ("a", 0, "p", False), ("a", 1, "q", False), (None, 0, "u\n", False), (None, 0, "v", True), (None, 0, None, False)]
    assert got == sorted(map(str, want))


def test_crawl_goes_on(spark):
    """A run over a part and one over all leave what one over all does; errors are taken up again."""
    makes, years = [("a",), ("b",), ("c",)], [("a", "1"), ("a", "2"), ("b", "1")]
    models = [("a", "1", "x"), ("a", "1", "y"), ("b", "1", "x")]
    keys = [("a", "1", "x", "1", "key"), ("a", "1", "x", "2", "pts"), ("b", "1", "x", "3", None), ("b", "1", "x", "3", None), ("b", "1", "x", "4", None)]
    pages = [("a", "1", "x", "1", 2, None), ("a", "1", "x", "2", 0, None), ("b", "1", "x", "3", None, "timeout")]
    names = "make string, year string, model string"
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = [make(makes, "make string"), make(years, "make string, year string"), make(models, names), make(keys, names + ", recnum string, key_type string")]
    got = make(pages, names + ", recnum string, wires int, problem string")
    none = make([], names + ", state string"), make([], names + ", recnum string, key_type string, status string, problem string")
    marks, vehicles = crawl.resume(*tables, got, *none)
    shown = lambda df: sorted(map(str, df.collect()))
    assert {tuple(r) for r in marks.collect()} == {("c", "", "", "no_years"), ("a", "2", "", "no_models"), ("a", "1", "y", "no_keys"), ("a", "1", "x", "done")}
    assert {(r["recnum"], r["status"], r["problem"]) for r in vehicles.collect()} == {("1", "ok", None), ("2", "no wire table", None), ("3", "error", "timeout"), ("4", "error", "no page"), (None, "no key types", None)}
    again = crawl.resume(*tables, got, marks, vehicles)
    assert shown(again[0]) == shown(marks) and shown(again[1]) == shown(vehicles)
    part = crawl.resume(*[t.where("make = 'a'") for t in tables], got, *none)
    both = crawl.resume(*tables, got, *part)
    assert shown(both[0]) == shown(marks) and shown(both[1]) == shown(vehicles)
    mended = make([("b", "1", "x", "3", 1, None), ("b", "1", "x", "4", 1, None)], names + ", recnum string, wires int, problem string")
    marks, vehicles = crawl.resume(*tables, mended, marks, vehicles)
    assert ("b", "1", "x", "done") in {tuple(r) for r in marks.collect()} and vehicles.where("status = 'error'").count() == 0 and vehicles.count() == 5


def test_pictures_by_two_keys(spark):
    fetched = [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u1", "h9"), (4, "u3", None), (5, "u3", "h2"), (6, "u4", None), (7, "old", "h3"), (8, "u5", "h7"), (9, None, "h8")]
    out, new = crawl.store_pictures(spark.createDataFrame(fetched, "seq long, url string, hash string"), spark.createDataFrame([("old", "i0")], "url string, image_id string"), spark.createDataFrame([("i0", "h5"), ("i7", "h7")], "image_id string, hash string"))
    got = {r["url"]: (r["image_id"], r["how"]) for r in out.collect()}
    assert got["old"] == ("i0", "url") and got["u5"] == ("i7", "content") and got["u1"][0] == got["u2"][0] and (got["u1"][1], got["u2"][1], got["u3"][1]) == ("new", "content", "new")
    assert set(got) == {"old", "u1", "u2", "u3", "u5"} and sorted(r["hash"] for r in new.collect()) == ["h1", "h2"]


def test_tracker(spark):
    vehicles = spark.createDataFrame([(1, "B", "2010", "m", "ok"), (2, "B", "classic", "m", "error"), (3, "A", "9", "m", "no wire table"), (4, "B", "2009", "m", "ok")], "vehicle int, make string, year string, model string, status string")
    rows = [(1, 1, "Constant +12 Volts (2)", "Red", "null", "kick", "30A", "p"), (1, 2, "constant 12v", None, "", "dash", None, None), (1, 3, "Ignition", "blue", "+", None, None, None), (1, 4, "Ignition", "blue", "+", None, "later", None), (1, 5, "Ignition Interrupt", "x", "+", None, None, "p"), (2, 1, "Ignition", "x", "+", None, None, "p")]
    wires = spark.createDataFrame(rows, "vehicle int, pos int, function string, color string, polarity string, location string, notes string, photo string")
    out = crawl.tracker(vehicles, wires).orderBy(*crawl.report_order()).collect()
    assert [(r["vehicle"], r["ordinal"], r["power_label"], r["ignition_label"]) for r in out] == [(3, 1, "Not found on site", "Not found on site"), (4, 1, "Not found on site", "Not found on site"), (1, 1, "Found", "Not found on site"), (1, 2, "Not found on site", ""), (2, 1, "Error", "Error")]
    assert out[2]["power_option"] == "Constant +12 Volts (2): Red kick (30A)" and out[2]["ignition_option"] == "Ignition: blue +" and out[2]["embedded"] and not crawl.tracker(vehicles, wires, 1).first()["embedded"]


def test_listing(spark):
    """Shortcuts, cycles, folders of one name, files named twice, and kinds that are skipped."""
    d, s, pdf = listing.FOLDER, listing.SHORTCUT, "application/pdf"
    rows = [("F", "b", d, "root", None, None), ("G", "a", d, "F", None, None), ("H", "a", d, "root", None, None), ("X", "x", d, "Y", None, None), ("Y", "y", d, "X", None, None), ("Z", "z", d, "gone", None, None)]
    rows += [("1", "one", pdf, "root", None, None), ("2", "two.pdf", pdf, "G", None, None), ("3", "three.doc", "application/msword", "H", None, None), ("4", "lost.pdf", pdf, "X", None, None), ("5", "cut", s, "H", "2", pdf), ("6", "to folder", s, "root", "F", d), ("7", "no target", s, "root", None, None), ("8", "sheet", "application/vnd.google-apps.document", "H", None, None), ("9", "n", None, "root", None, None)]
    files, skipped = listing.listing(spark.createDataFrame(rows, "id string, name string, mime string, parent string, target_id string, target_mime string"), "root")
    assert [(r["id"], r["file_name"], r["type"], r["folder"], r["rank"]) for r in listing.position(files).orderBy("rank").collect()] == [("1", "one.pdf", "PDF", "", 1), ("2", "cut.pdf", "PDF", "a", 2), ("8", "sheet.pdf", "Google Doc", "a", 3)]
    assert {r["type"]: r["n"] for r in skipped.collect()} == {"Old Word (.doc)": 1, "Shortcut to a folder": 1, "Shortcut": 1, "Shortcut to a file already listed": 1, "Other": 1}


def test_near_words(spark):
    words = ["red", "rde", "redd", "rd", "bed", "blue", "bluee", "lue", "bue", "b", "", None, "greeen", "grey"]
    vocab = ["red", "blue", "green", "gray", None, ""]
    one = lambda a, b: a != b and (
        (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    )
    index = vocabulary.vocabulary_index(spark.createDataFrame([(v,) for v in vocab], "word string"))
    got = {r["word"]: r["meant"] for r in vocabulary.near_words(spark.createDataFrame([(w,) for w in words], "word string"), index).collect()}
    want = {w: min(v for v in vocab if v and one(w, v)) for w in words if w and w not in vocab and any(v and one(w, v) for v in vocab)}
    assert got == want and len(want) >= 6


def test_catalogue_falls_back(spark):
    rows = [("makes", 1, None, None, None, "[]"), ("page", 1, None, None, None, '<select id="make"><option value="">-</option><option value="Acura">A</option></select>'), ("years", 1, "Acura", None, None, "oops"), ("years", 2, "Acura", None, None, '[2010, "2011", {"year": 2012}, {"y": 1}]'), ("models", 1, "Acura", "2010", None, '[{"name": "TL"}]'), ("models", 2, "Acura", "2010", None, '["never"]'), ("models", 1, "Acura", "1999", None, '["lost"]'), ("keys", 1, "Acura", "2010", "TL", '[{"pid": 7, "kt": "key"}, {"kt": "none"}]')]
    makes, years, models, keys = catalog.lattice(spark.createDataFrame(rows, "api string, source int, make string, year string, model string, body string"))
    assert [r[0] for r in makes.collect()] == ["Acura"] and sorted(r["year"] for r in years.collect()) == ["2010", "2011", "2012"]
    assert [tuple(r) for r in models.collect()] == [("Acura", "2010", "TL")] and [tuple(r) for r in keys.collect()] == [("Acura", "2010", "TL", "7", "key")]


def test_leases(spark):
    """A lease that is prolonged, one that ends late, one that is claimed again, and events that mean nothing."""
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("a", at(0), 1, "claim"), ("a", at(10), 2, "heartbeat"), ("a", at(20), 3, "done"), ("b", at(0), 4, "claim"), ("b", at(30), 5, "heartbeat"), ("b", at(40), 6, "claim"), ("c", at(5), 7, "heartbeat"), ("d", at(30), 8, "claim"), ("e", at(44), 9, "claim"), ("b", at(59), 10, "done"), ("f", at(0), 11, "claim"), ("f", at(15), 12, "done")]
    out = stale_leases(spark.createDataFrame(rows, "job string, ts string, ord int, event string"), 900, 2).collect()
    base = 1704067200000
    assert sorted((r["job"], (r["ended"] - base) // 60000, r["attempts"], r["status"]) for r in out) == [("b", 15, 1, "pending"), ("b", 55, 2, "failed"), ("d", 45, 1, "pending")]


def test_deep_headings_and_long_tables(spark):
    """Levels beyond any usual one hold, and the parts of a table with very many rows don't meet the next block."""
    long = "\n".join(["head"] + [f"row {i} " + "x" * 3300 for i in range(60)])
    rows = [("heading", f"L{k}", k, None, 1) for k in (1, 4, 12, 30)] + [("paragraph", "deep " * 30, None, None, 1), ("heading", "again", 12, None, 2), ("table", long, None, None, 2), ("paragraph", "after " * 30, None, None, 3)]
    out = chunk_blocks(spark.createDataFrame(blocks(rows), BLOCK)).orderBy("chunk_index").collect()
    assert next(r["section_path"] for r in out if "deep deep" in r["text"] and not r["is_parent"]) == "L1 > L4 > L12 > L30"
    tables = [r for r in out if r["kind"] == "table"]
    assert len(tables) == 60 and all(r["section_path"] == "L1 > L4 > again" and "head\n" in r["text"] for r in tables)
    assert [t["text"].split("row ")[1].split(" ")[0] for t in tables] == [str(i) for i in range(60)] and "after" in out[-1]["text"]
