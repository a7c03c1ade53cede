"""Each stage of the corpus pipeline against brute force on its own input, and the queries against their SQL."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import _common, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    out, base = [], say(80)
    for i in range(40):
        text = say(30) + ("\nCommon footer here" if i % 3 else "") + "\n" + say(12)
        if 10 <= i < 16:
            w = base.split(" ")
            w[i] = "changed"
            text = " ".join(w)
        if 20 <= i < 33:
            text = base + "\ncopied whole"
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    return out + [(50, "too short", "en", None, 9), (51, None, None, None, None), (52, "", "en", "src1", 0), (53, "again and again " * 40, "en", "src1", 640)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = [("input", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, "")
        out.append((name, frame.collect()))
        docs = spark.createDataFrame(out[-1][1], frame.schema)
    return out


def words(text):
    return (text or "").lower().split()


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in stages[1][1]}
    assert kept == set(range(40)), "short, empty and repetitive documents go, the others stay"


def test_line_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1][1]}
    keys = {i: {x.strip().lower() for x in t.split("\n")} for i, t in before.items()}
    for r in stages[2][1]:
        lines = before[r["doc_id"]].split("\n")
        left = "\n".join(x for x in lines if not x.strip() or sum(x.strip().lower() in k for k in keys.values()) < corpus_pipeline.LINE_DOCS)
        assert r["text"] == (left if left.strip() else before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert len(stages[2][1]) == len(before)


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_line_stage_empties_boilerplate(spark, monkeypatch, broadcast):
    """Pages of different choices of frequent lines lose them all; texts of ten or more equal documents stay, those of fewer go."""
    monkeypatch.setattr(_common, "BROADCAST_ROWS", broadcast)
    pool = [f"navigation and licence line {k}" for k in range(6)]
    pages = [(i, "\n".join(x for k, x in enumerate(pool) if i + 1 & 1 << k)) for i in range(63)]
    copies = [(100 + i, "a copied text\nof two lines") for i in range(10)]
    repeated = [(200, pool[0] + "\n" + pool[1] + " ")] * 12
    rows = [(i, t, "en", "s", len(t)) for i, t in pages + copies + repeated] + [(300, None, "en", "s", None), (301, "own", "en", "s", 3)]
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert len(out) == len(rows)
    for r in out:
        text = "a copied text\nof two lines" if 100 <= r["doc_id"] < 110 else "own" if r["doc_id"] == 301 else ""
        assert (r["text"] or "").strip() == text and (r["n_chars"] or 0) == len(r["text"] or "")


def test_jaccard_stage(stages):
    sets = {r["doc_id"]: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(words(r["text"])) for r in stages[2][1]}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert sorted(r["doc_id"] for r in stages[3][1]) == sorted(set(root.values())) and len(set(root.values())) < len(sets)


def test_mix_stage(stages):
    size = {}
    for r in stages[3][1]:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    total = sum(size.values())
    level = total / sum(weight.values())
    assert all(level * weight[s] <= 3 * size[s] for s in size), "no source is clamped here"
    longest = max(len(words(r["text"])) for r in stages[3][1])
    for s in size:
        taken = sum(len(words(r["text"])) for r in stages[4][1] if r["source"] == s)
        assert abs(taken - level * weight[s]) <= longest / 2


def test_encode_stage(stages):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4][1]}
    assert len(stages[5][1]) == len(stages[4][1])
    for r in stages[5][1]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest()


CLASHING = SCHEMA + ", copy string, whole_text string, rest string, size long, n long, `a.b` string, copied boolean, salt int"


def odd_rows():
    """Nulls in every column, repeated rows, equal ids with other texts, a long text, copies, and columns with the stages' own names."""
    say = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    base = [(1, say(40, 1), "en", "a", 9), (1, say(40, 1), "en", "a", 9), (1, say(40, 2), None, "a", None), (None, say(40, 3), "en", None, 1), (None, say(40, 3) + " more", "en", None, 1), (None, None, None, None, None), (4, "", "en", "b", 0), (5, say(200_000, 5), "en", "b", 3), (6, None, "en", "b", None)]
    base += [(10 + i, say(30, 7) + "\n" + say(30, 8), "de", "b", 5) for i in range(12)]
    return [(*r, "copy", "whole", "rest", 77, 78, "dot", None, 3) for r in base]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(odd_rows(), CLASHING)
    out = stage(spark, docs, "")
    rows, ids = out.collect(), [r[0] for r in odd_rows()]
    assert {r["doc_id"] for r in rows} <= set(ids)
    none = stage(spark, spark.createDataFrame([], CLASHING), "")
    assert none.columns == out.columns and none.collect() == []
    if k + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == docs.columns
        assert all((r["copy"], r["whole_text"], r["rest"], r["size"], r["n"], r["a.b"], r["copied"], r["salt"]) == ("copy", "whole", "rest", 77, 78, "dot", None, 3) for r in rows)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows) or name != "line dedup"
    count = lambda i: sum(r["doc_id"] == i for r in rows)
    texts = {r["text"] for r in rows} if "text" in out.columns else set()
    if name == "quality rules":
        assert (count(1), count(None), count(4), count(5), count(6), count(10)) == (3, 2, 0, 1, 0, 0)
    elif name == "line dedup":
        assert len(rows) == len(ids) and texts == {r[1] or "" for r in odd_rows()}
    elif name == "n-gram Jaccard join":
        assert (count(1), count(None), count(4), count(5), count(6)) == (2, 2, 1, 1, 1) and sum(count(10 + i) for i in range(12)) == count(10) == 1
    elif name == "mixing to target weights":
        assert texts <= {r[1] for r in odd_rows()}
    else:
        assert len(rows) == len(ids) and count(None) == 3


def test_queries_equal_sql(spark, tmp_path):
    """The SQL of the operators, on rows with nulls and odd URLs."""
    folder = str(tmp_path)
    spark.createDataFrame([r for r in rows() if r[3] is not None or r[1] is not None], SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    urls = [None, "", "x", "http://A.example.ORG/es/1?q", "https://b.com/fr/#t", "http://com/de/", "ftp://org/", "http://x.example.org/en/10"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    r = random.Random(2)
    vectors = [(i, i % 3 if i % 20 else None, [r.gauss(0, 1) for _ in range(8)]) for i in range(240)]
    vectors += [(300 + i, 1, [x + 0.01 * i for x in vectors[1][2]]) for i in range(9)] + [(400, 1, None), (401, 1, [float("nan")] * 8), (402, 1, [None] * 8), (403, 2, [0.0] * 8), (404, 1, vectors[1][2])]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    for name, sql in registry.SQL.items():
        own = registry.QUERIES[name](spark, folder)
        columns = sorted(own.columns)
        got = sorted(map(str, (tuple(r[c] for c in columns) for r in own.collect())))
        assert got == sorted(map(str, con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())), name
