"""Cap filters, the Merkle manifest and hard negatives against brute force, with every odd case."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _common, cap_filters, hard_negatives, merkle
from lodestone.operators import bucket_links, components

VECTORS = "vec_id long, label int, embedding array<float>, n_links string, h1 string, kept string, id string"


def vectors():
    """Copies, a large group of near copies, a chain, ties, repeated rows, and rows that can't take part."""
    r = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [(i, int(r.integers(0, 4)), unit(r.standard_normal(24)) * r.uniform(0.5, 9)) for i in range(0, 160)]
    base = unit(r.standard_normal(24))
    rows += [(i, 1, unit(base + 0.02 * r.standard_normal(24))) for i in range(200, 300)]
    step = unit(r.standard_normal(24))
    for i in range(300, 312):
        step = unit(step + 0.03 * r.standard_normal(24))
        rows.append((i, 2, step))
    rows += [(i, 3, base) for i in range(320, 340)] + [(340, 3, -base), (341, 2, base * 3), (342, 2, base)]
    rows += [(7, rows[7][1], rows[7][2]), (350, 0, r.standard_normal(5)), (350, 0, r.standard_normal(5)), (351, 0, rows[-1][2])]
    rows = [(i, label, None if v is None else [float(x) for x in np.float32(v)]) for i, label, v in rows]
    odd = [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 24), (403, 1, [None] * 24), (404, 1, [float("nan")] * 24), (405, 1, [float("inf")] * 24), (406, None, rows[0][2]), (None, 1, rows[0][2]), (None, None, None), (407, 0, [1.0]), (408, 0, [2.0]), (409, 0, [-1.0])]
    return [(*row, "a", "b", "c", "d") for row in rows + odd]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), VECTORS).repartition(5).cache()


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("small", [False, True])
def test_cap_filters(table, monkeypatch, small):
    if small:
        monkeypatch.setattr(bucket_links, "BLOCK", 30)
        monkeypatch.setattr(bucket_links, "BUNDLE", 50)
        monkeypatch.setattr(bucket_links, "BROADCAST_BUCKETS", 0)
        monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(components, "EDGES_AT_ONCE", 0)
    rows = vectors()
    part = sorted({(r[0], r[1], tuple(r[2])) for r in rows if r[0] is not None and r[1] is not None and finite(r[2]) and any(r[2])})
    links = {p: set() for p in part}
    for a in part:
        for b in part:
            if a[1] == b[1] and len(a[2]) == len(b[2]) and a != b:
                x, y = np.array(a[2], np.float64), np.array(b[2], np.float64)
                if (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= 0.98:
                    links[a].add(b)
    want = []
    for i, label, v, *_ in rows:
        seen = todo = {(i, label, tuple(v))} & set(part) if v is not None else set()
        n = len(links[next(iter(todo))]) if todo else 0
        while todo:
            todo = set().union(*(links[p] for p in todo)) - seen
            seen = seen | todo
        least = min((p[0] for p in seen), default=i)
        want.append((str(i), n, str(least), least == i))
    out = cap_filters.near_duplicates(table)
    assert set(out.columns) == set(table.columns) | {"n_links", "component_id", "kept"} and len(out.columns) == len(set(out.columns))
    got = [(str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[1] > 90 for w in want) > 90


def test_cap_filters_find_what_they_promise():
    alpha, codes = cap_filters.tuned(64, 64, 0.98, 0.9999)
    r = np.random.default_rng(99)
    x, y = r.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met, size = set(), 0
    for code in range(codes):
        (i, f), (j, g) = cap_filters.decoded(x, code, 64, alpha), cap_filters.decoded(y, code, 64, alpha)
        met |= {a for a, _ in set(zip(i.tolist(), f.tolist(), strict=True)) & set(zip(j.tolist(), g.tolist(), strict=True))}
        size += len(i)
        if code == 0:
            a, b = cap_filters.halves(x, 0, 64)
            every = a[:, :, None] + b[:, None, :] >= alpha
            assert {(p, q * 64 + s) for p, q, s in zip(*np.nonzero(every), strict=True)} == set(zip(i.tolist(), f.tolist(), strict=True))
    assert len(met) >= 1996 and size / 2000 < 60
    v = cap_filters.rotated(x, 3)
    assert np.allclose(v @ v.T, x @ x.T)


@pytest.mark.parametrize("name", ["cap", "negatives"])
def test_empty_vectors(spark, name):
    empty = spark.createDataFrame([], VECTORS)
    out = cap_filters.near_duplicates(empty) if name == "cap" else hard_negatives.mine_negatives(empty, F.col("vec_id") % 2 == 0)
    assert out.collect() == []


@pytest.mark.parametrize("at_once", [8192, 20])
def test_hard_negatives(table, monkeypatch, at_once):
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", at_once)
    rows = sorted({(r[0], r[1], tuple(r[2])) for r in vectors() if r[0] is not None and r[1] is not None and finite(r[2])})
    whole = [np.floor(256 * np.array(v, np.float64)) for _, _, v in rows]
    want = []
    for (i, label, v), x in zip(rows, whole, strict=True):
        if i % 3:
            continue
        scored = sorted((-int(x @ y), r[0], r[1] == label) for r, y in zip(rows, whole, strict=True) if len(y) == len(v))
        for p, j, _ in [s for s in scored if s[2] and s[1] != i][:5]:
            fit = [(n, q) for n, q, same in scored if not same and 80 * -p <= 100 * -n <= 100 * -p]
            want += [(i, j, k + 1, q, -p, -n) for k, (n, q) in enumerate(fit[:5])]
    got = [tuple(r) for r in hard_negatives.mine_negatives(table, F.col("vec_id") % 3 == 0).collect()]
    assert sorted(got) == sorted(want) and len(want) > 500


def test_scores_past_float64_are_refused(spark):
    rows = spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="aren't exact"):
        hard_negatives.mine_negatives(rows, F.lit(True)).collect()


def documents():
    texts = ["a\nb", "", None, "Éa\n", "long " * 20000 + "\n", "x", "x", "tail"]
    rows = [(i, texts[i % 8], "src" + "é\U0001f600ab"[i % 4], "en" if i % 5 else None, None if i % 7 == 0 else i) for i in range(61)]
    rows += [(100, "alone", "one", "de", 5), (3, "a\nb", "srcé", "en", 3), (3, "a\nb", "srcé", "en", 3)]
    rows += [(i, "no source", None, None, None) for i in (9, 8, None, None)]
    return [(*r, "n", 1) for r in rows]


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, idx int"


def manifest_by_hand(rows, fanout):
    """For each row (doc_id, leaf): subroot, root and path; equal rows each have their own."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        found = [[] for _ in leaves]
        nodes, at = list(leaves), list(range(len(leaves)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = nodes[place // fanout * fanout :][:fanout]
                found[k].append(("".join(run[: place % fanout]), "".join(run[place % fanout + 1 :])))
                at[k] = place // fanout
            nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        return nodes[0], found

    groups = {}
    for doc_id, text, source, lang, n_chars, *_ in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, h(*map(code, (doc_id, source, lang, n_chars, text)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = tree([below[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (has, doc_id, leaf), path in zip(sorted(groups[s]), below[s][1], strict=True):
            out.append((str(doc_id if has else None), str(s), leaf, below[s][0], root, tuple(path + up)))
    return out


@pytest.mark.parametrize(("fanout", "small"), [(3, False), (2, True)])
def test_manifest(spark, monkeypatch, fanout, small):
    if small:
        monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(6)
    out = merkle.manifest(docs, fanout=fanout, shown=F.lit(1)).withColumn("up", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    got = [(str(r["doc_id"]), str(r["source"]), r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in out]
    assert sorted(got) == sorted(manifest_by_hand(documents(), fanout))
    assert all(r["up"] == r["root"] and r["shown"] == 1 for r in out)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    rows = documents()[:n]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["leaf"], r["root"], tuple(map(tuple, r["path"]))) for r in out) == sorted((x[2], x[4], x[5]) for x in (manifest_by_hand(rows, 3) if n else []))


def test_manifest_query_tampers(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op12_merkle(spark, str(tmp_path)).collect()
    ends = {r[0] for r in documents() if r[1] and "\n" in r[1]}
    for r in out:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["doc_id"] in ends
        assert r["verified"] == (not hit) and (r["folded_root"] == r["root"]) == r["verified"]
    assert len(out) == len(documents()) and {r["verified"] for r in out} == {True, False}


def test_large_components(spark, monkeypatch):
    """The rounds by joins and the one task give the same."""
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 900, (700, 2))] + [(1000, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long").select(*[F.struct(F.col(c).alias("x"), F.lit("s").alias("y")).alias(c) for c in "ab"])
    few = sorted(map(str, components.components(edges).collect()))
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 0)
    assert sorted(map(str, components.components(edges).collect())) == few
