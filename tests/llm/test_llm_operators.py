"""Each operator against brute force or the library that it must equal, on small rows with every odd case."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard, line_dedup, mixing, neighbours, paragraph_dedup, quality, shingles, substring_dedup, suffix_arrays, token_count, url_filter

SCHEMA = "doc_id long, text string, source string, n_lines int, kept string, id string, row string"
LONG = "nouns and verbs " * 4000
PASSAGE = "a passage that many of these documents share, word for word, and that is long enough to be found"


def corpus():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, and columns with clashing names."""
    r = random.Random(5)
    words = ["the", "of", "Éa", "tion", "be", "zu", "und", "ou", "ing", "er"]
    say = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    base = say(60)
    rows = [(1, None, "a"), (2, "", "a"), (None, base, "b"), (None, None, None), (5, LONG, None), (6, base, "a"), (7, base, "b"), (7, base, "b"), (8, "one two", "a"), (9, " \n\t ", "b")]
    for i in range(10, 24):
        near = base.split(" ")
        near[i % 60] = f"w{i}"
        rows.append((i, " ".join(near) if i % 2 else say(30) + "\n" + PASSAGE + "\nShared Line \n" + say(3), "abc"[i % 3]))
    rows += [(30, "Shared line\n\nShared line", "\U0001f600"), (31, "é\x00<|endoftext|> 'LL", "")]
    return [(i, t, s, 1, "k", "x", "y") for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def words(text):
    return (text or "").encode().lower().split()


OPERATORS = {
    "mix": lambda d: mixing.mix_sources(d),
    "encode": lambda d: bpe.decode(bpe.encode(d)),
    "jaccard": lambda d: jaccard.similar_groups(d),
    "count": lambda d: token_count.count_tokens(d),
    "paragraphs": lambda d: paragraph_dedup.dedup_paragraphs(d),
    "substring": lambda d: substring_dedup.repeated_spans(d),
    "urls": lambda d: url_filter.filter_urls(d, url_filter.PRODUCTION_RULES, "text"),
    "quality": lambda d: quality.quality_rules(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_keeps_rows_and_columns(docs, name):
    out = OPERATORS[name](docs)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)
    assert ids(out.select("doc_id").collect()) == ids(docs.select("doc_id").collect())
    again = OPERATORS[name](docs.repartition(5))
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        assert r["size"] == len(words(r["text"])) and r["taken"] == r["size"] * r["repetitions"] and r["repetitions"] <= 3
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped and size[s])
        more = {s for s in order if s not in capped and size[s] and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        target = 3 * size[s] if s in capped else level * weight[s]
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == size[s] for r in own)
        longest = max(r["size"] * sum(q["doc_id"] == r["doc_id"] and q["text"] == r["text"] for q in own) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= longest / 2 + 1e-6


def test_water_fill_clamps_in_rounds(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 3.0), ("c", 30, 3.0), ("d", 0, 1.0), ("e", 9, None)], "source string, source_size long, weight double")
    found = {r["source"]: r["target"] for r in mixing.water_fill(sources, 149, 2).collect()}
    assert found == {"a": 20.0, "b": 69.0, "c": 60.0, "d": 0.0, "e": 0.0}
    assert sum(r["target"] for r in mixing.water_fill(sources, 10_000, 2).collect()) == 280


def texts_of_all_kinds():
    r = random.Random(3)
    bits = [" ", "  ", "a", "The", "\n", "É", "é", "<|endoftext|>", "<|startoftext|>", "<s>", "▁", "'s", "\t", "日本", "ing", "　", "\x00", "\x1c", "\x85", "😀", "...", "12", "Σ", "ΑΣ", "İ", "ththe"]
    return ["", " "] + ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]


def test_bpe_equals_library():
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of_all_kinds()
    own = bpe.bpe_of("word_bpe_49k.json")
    for text, raw, whole in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.ids, text


def test_bpe_query_columns(docs):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = bpe.round_trip(docs).select("text", "ids", F.col("ids_sha256").alias("sha"), "decoded").collect()
    apart = bpe.decode(bpe.encode(docs)).select("text", "ids", "decoded").collect()
    assert sorted((str(r["text"]), r["ids"], r["decoded"]) for r in apart) == sorted((str(r["text"]), r["ids"], r["decoded"]) for r in out)
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["sha"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_compatible_pairs_against_merging():
    own = bpe.bpe_of("word_bpe_49k.json")
    r = np.random.default_rng(0)
    whole = [t for t, s in enumerate(own.strings[:49406]) if not s.endswith("</w>") and own.merge(own.symbols(s)) == [t]]
    a, b = r.choice(whole, 400), r.choice(whole, 400)
    found = own.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), found, strict=True):
        assert ok == (own.merge(own.symbols(own.strings[x]) + own.symbols(own.strings[y])) == [x, y])


def test_token_counts_equal_library():
    counts = token_count.counts_of("piece_bpe_32k.model")
    texts = texts_of_all_kinds()
    assert counts.count_batch(texts) == [len(x) for x in counts.model.encode(texts)]


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 90), (1, 50)])
def test_jaccard(spark, width, percent):
    r = random.Random(width)
    rows = [(x[0], x[1]) for x in corpus() if x[0] is not None]
    for i in range(100, 160):
        rows.append((i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 14)))))
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {(q["doc_id"], q["n_shingles"], q["component_id"]) for q in out} == {(i, len(s), find(i)) for i, s in sets.items()}


def test_one_of_each_group(spark):
    """Repeated rows and null ids leave one row of a group; documents without words stay, once each."""
    base = " ".join(f"w{i}" for i in range(80))
    near = lambda k: base.replace(f"w{k} ", "changed ")
    rows = [(5, base, "a"), (5, base, "a"), (5, base, "b"), (None, near(70), "c"), (7, near(3), "d"), (None, "null ids alone " * 9, "e"), (None, "null ids alone " * 9, "f"), (8, "", "g"), (9, None, "h"), (9, None, "h"), (None, None, "i"), (3, "something else here", "j")]
    assert near(3) != base != near(70)
    out = jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted([("5", base), ("None", "null ids alone " * 9), ("8", ""), ("9", "None"), ("None", "None"), ("3", "something else here")])


def test_join_keys_by_shuffle(spark, monkeypatch):
    """A key table that is too long to broadcast is joined over salts, with the same rows; nulls are equal."""
    from lodestone.llm import _common

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(200)], "id long, k long")
    keys = _common.save(spark.createDataFrame([(0, "a"), (1, "b"), (None, "n"), (9, "z")], "k long, v string"), "keys")
    shown = lambda how: sorted(map(str, _common.join_keys(rows, keys, ["k"], ["id"], how).collect()))
    short = {how: shown(how) for how in ("inner", "left", "left_anti")}
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    assert {how: shown(how) for how in short} == short and len(short["left"]) == 200


def test_shingles_of_pieces():
    texts = [b"", b" a\tb ", b"A b C d", LONG.encode(), b"c d a b c"]
    alone = [next(shingles.shingles([t], 3)) for t in texts]
    assert [a.tolist() for a in shingles.shingles(texts, 3)] == [a.tolist() for a in alone]
    assert [len(a) for a in alone] == [0, 1, 2, 3, 3] and alone[2][0] in alone[2]


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(400, 16)).astype(np.float32)
    vectors[50:90] = vectors[40]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(0, vectors[0].tolist())]
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 15 + [None]), (504, [float("inf")] * 16), (None, [1.0] * 16), (505, [1.0] * 3), (506, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    out = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    exact = vectors.astype(np.float64)
    hits = 0
    for q in range(0, 400, 20):
        score = (exact * exact[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        own = sorted((x["rank"], x["vec_id"], x["score"]) for x in out if x["query_id"] == q)
        assert [x[0] for x in own] == list(range(1, 21)) and all(abs(x[2] - score[x[1]]) < 1e-12 for x in own)
        assert [(-x[2], x[1]) for x in own] == sorted((-x[2], x[1]) for x in own)
        hits += len({x[1] for x in own} & set(best))
    assert hits >= 0.9 * 20 * 20 and {x["query_id"] for x in out} == set(range(0, 400, 20))


def test_neighbours_beside_a_dense_group(spark):
    """A third of the rows are near copies of one vector: queries inside and outside find their neighbours."""
    r = np.random.default_rng(3)
    exact = r.normal(size=(6000, 32))
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    exact[::3] = exact[0] + 0.004 * r.normal(size=(2000, 32))
    exact /= np.linalg.norm(exact, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(exact)], "vec_id long, embedding array<double>")
    own: dict[int, set] = {}
    for x in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        own.setdefault(x["query_id"], set()).add(x["vec_id"])
    for inside in (True, False):
        hits = []
        for q in (i for i in range(0, 6000, 50) if (i % 3 == 0) == inside):
            score = (exact * exact[q]).sum(1)
            score[q] = -2
            hits.append(len(own[q] & set(np.argsort(-score)[:20].tolist())) / 20)
        assert len(hits) >= 40 and np.mean(hits) >= 0.93, (inside, np.mean(hits))


def test_neighbours_of_each_length(spark):
    rows = [(20, [1.0, 0.0]), (3, [0.5, 0.0]), (40, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [2.0, 1.0, 0.0]), (60, [1.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in out) == [(20, 1, 3, 0.5), (40, 1, 5, 2.0), (40, 2, 4, 0.0)]


def test_neighbours_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.5, 0.1])], schema)
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1, 3, 1.0), (20, 2, 2, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], schema), F.lit(True)).collect() == []


@pytest.mark.parametrize("shard_bytes", [1 << 21, 400])
def test_substrings(docs, shard_bytes):
    out = substring_dedup.repeated_spans(docs, shard_bytes=shard_bytes).collect()
    rows = [((1 << 63) - 1 if x[0] is None else x[0], (x[1] or "").encode()) for x in corpus()]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    for r in out:
        i, t = (1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        assert r["n_bytes"] == len(t) and r["n_removed"] == gone.sum()
        assert bytes(r["kept"]) == np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert len(r["spans"]) == (np.diff(np.r_[0, gone.astype(int)]) == 1).sum()


@pytest.mark.parametrize("text", [b"a", b"a" * 40, b"ab" * 30, b"\0" * 90, bytes(random.Random(1).choices(b"abc", k=900)), bytes(random.Random(2).choices(b"ab", k=70)) * 9])
def test_suffix_array_and_common_prefixes(text):
    raw = np.frombuffer(text, np.uint8)
    order, place = suffix_arrays.suffix_array(raw)
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == expected
    common = suffix_arrays.common_prefixes(raw, order, place, 50)
    for k in range(1, len(text)):
        a, b = text[expected[k - 1] :], text[expected[k] :]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or i == 50), min(len(a), len(b), 50))


def test_merge_by_binary_search():
    runs = [(np.array([b"a", b"c", b"d"]), np.array([5, 6, 7])), (np.array([b"b", b"c"]), np.array([1, 2])), (np.array([], "S1"), np.array([], np.int64))]
    assert [m.tolist() for m in substring_dedup.merge_sorted(runs)] == [[5, 2, 7], [1, 2], []]


URLS = [None, "", "nothing", "http://", "http://org", "http://A.ORG/x", "http://example.org/es/1", "http://x.example.org/en/123", "http://badexample.org/es/", "https://b.com/fr/?a", "http://com/de/#x", "http://b.com/de", "http://u:p@x.com:80/fr/"]


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5])], "page_id long, url string")
    found = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame, url_filter.PRODUCTION_RULES).collect()}
    assert found[None] == ("", "", None, "block") and found["nothing"] == ("", "", None, "block")
    assert found["http://org"] == ("org", "", None, "allow")
    assert found["http://A.ORG/x"] == ("a.org", "/x", "org/", "allow")
    assert found["http://example.org/es/1"][2:] == ("example.org/es/", "block")
    assert found["http://x.example.org/en/123"][2:] == ("example.org/en/1", "block")
    assert found["http://badexample.org/es/"][2:] == ("org/", "allow")
    assert found["https://b.com/fr/?a"] == ("b.com", "/fr/", "com/fr/", "allow")
    assert found["http://com/de/#x"][2:] == ("com/de/", "block") and found["http://b.com/de"][2:] == (None, "allow")
    assert found["http://u:p@x.com:80/fr/"][2:] == (None, "allow")


def test_url_word_and_tokenless_rules(spark):
    frame = spark.createDataFrame([("http://x.com/Casino/1",), ("http://x.com/casinos",), ("http://é.com/ü",)], "url string")
    rules = [url_filter.word_rule("casino"), url_filter.Rule("ü", "block", "ü", ())]
    found = {r["url"]: r["rule"] for r in url_filter.filter_urls(frame, rules).collect()}
    assert found == {"http://x.com/Casino/1": "*casino*", "http://x.com/casinos": None, "http://é.com/ü": "ü"}


def test_base_stats():
    stats = quality.base_stats("a b# é\n\na b# é \na b# é\n \n ".encode())
    assert stats == (9, 12, 3, 1, 0)
    eight = " ".join("abcdefgh")
    assert quality.base_stats(f"{eight} x {eight} y".encode())[4] == 16
    assert quality.base_stats(("a " * 9).encode())[4] == 9


def test_repeated_words_against_brute_force(monkeypatch):
    """Texts of every size, past 1 MiB too, also where all windows have one hash."""
    r = random.Random(4)
    some = lambda n, k: b" ".join(b"w%d" % r.randrange(k) for _ in range(n))
    texts = [b"", b" \n ", b"a " * 7, b"a " * 9, b"A a " * 30, some(500, 3), some(5000, 40).replace(b" ", b" \n", 900), b"one two\tthree  four five\nsix seven eight " * 3]
    texts += [some(260_000, 10**6) + b" " + LONG.encode() * 20 + some(40_000, 4), b"x " * 600_000]

    def brute(text):
        w = text.split()
        often, hit = {}, set()
        for i in range(len(w) - 7):
            often.setdefault(tuple(w[i : i + 8]), []).append(i)
        for places in often.values():
            if len(places) > 1:
                hit.update(p + j for p in places for j in range(8))
        return len(w), len(hit)

    want = [brute(t) for t in texts]
    assert [quality.repeated_words(t) for t in texts] == want and len(texts[-2]) > 1 << 20
    monkeypatch.setattr(quality, "repeated_windows", lambda h, width: (np.arange(max(0, len(h) - width + 1)), np.zeros(max(0, len(h) - width + 1), np.uint64)))
    assert [quality.repeated_words(t) for t in texts[:-2]] == want[:-2]


def test_quality_takes_out_frequent_lines(spark):
    rows = [(i, f"Menu home {i % 10}\n" + " ".join(f"w{i}x{k}" for k in range(30)), "h") for i in range(15)] + [(i, "menu home 7\nmenu home 8 \n" + "q " * 2 + " ".join(f"z{k}" for k in range(18 if i == 99 else 19)), None) for i in (98, 99)]
    rows += [(50, "Menu Home 7\n" + "\n".join(["menu home 1"] * 30) + "\nlast words", "h")]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeat_percent=100).collect()}
    assert all(out[i]["kept"] and not out[i]["text"].startswith("Menu") for i in range(15))
    assert out[99]["kept"] and out[99]["text"].startswith("menu"), "the line is not frequent on another host"
    assert not out[50]["kept"] and not out[50]["base_failed"]


def line_result(rows, least):
    keys = lambda t: [x.strip().lower() for x in (t or "").encode().split(b"\n")]
    have = {}
    for i, t in {(i, t) for i, t in rows}:
        for k in set(keys(t)):
            have.setdefault(k, set()).add((i, t))
    out = {}
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        left = [x for x, k in zip(lines, keys(t), strict=True) if not k or len(have[k]) < least]
        out[i, t] = (len(lines), len(lines) - len(left), b"\n".join(left).decode())
    return out


@pytest.mark.parametrize("least", [1, 2, 5])
def test_lines(docs, least):
    rows = [(x[0], x[1]) for x in corpus()]
    expected = line_result(rows, least)
    out = line_dedup.dedup_lines(docs.withColumn("given", F.col("text")), min_docs=least).collect()
    for r in out:
        assert (r["n_lines"], r["n_dropped"], r["text"]) == expected[r["doc_id"], r["given"]]


def test_lines_are_reversible(docs):
    early, late = docs.where("doc_id < 15"), docs.where("doc_id >= 15 OR doc_id IS NULL")
    state = line_dedup.build_state(early, min_docs=3)
    both = line_dedup.update_state(state, late, 1)
    back = line_dedup.update_state(both, late, -1)
    view = lambda d, s=None: sorted(map(str, line_dedup.dedup_lines(d, s, min_docs=3).collect()))
    assert view(docs, both) == view(docs) and view(early, back) == view(early, state) != view(early, both)
    counts = lambda s: sorted(tuple(r) for r in s.counts.select("k1", "k2", "n_docs").collect())
    assert counts(back) == counts(state)


def test_lines_outgrow_their_shards(docs, monkeypatch):
    """With more keys than the shards hold the state is dealt anew, and results stay."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1)
    early, late = docs.where("doc_id < 12"), docs.where("doc_id >= 12 OR doc_id IS NULL")
    state = line_dedup.build_state(early, min_docs=3)
    both = line_dedup.update_state(state, late, 1)
    assert both.n_shards > 2 * state.n_shards
    assert sorted(map(str, line_dedup.dedup_lines(docs, both).collect())) == sorted(map(str, line_dedup.dedup_lines(docs, min_docs=3).collect()))


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all() and made.contains(keys + 1).mean() < 0.01
    made.remove(keys[:2000])
    assert made.contains(keys[2000:]).all() and made.contains(keys[:2000]).mean() < 0.01
    full = line_dedup.CuckooFilter(8)
    assert not full.insert(np.arange(200)), "a filter that is too small says so"
    again = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert again.insert(keys[:2000]) and again.contains(keys).all()


def test_bands_reach_recall():
    n_bands = paragraph_dedup.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**paragraph_dedup.ROWS) ** n_bands >= 0.999 > 1 - (1 - 0.8**paragraph_dedup.ROWS) ** (n_bands - 1)
    r = np.random.default_rng(1)
    met = 0
    for _ in range(2000):
        both = r.integers(-(1 << 63), (1 << 63) - 1, 90)
        a, b = paragraph_dedup.bands_of([both[:81], both[9:]], n_bands)
        met += bool((a == b).any())
    assert met >= 1985


def test_paragraphs_are_cut_alike():
    """A passage has the same paragraphs in the middle of different lines; nothing but white space is between them."""
    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    met = 0
    for _ in range(300):
        passage = say(60)
        cuts = []
        for _ in range(2):
            text = f"{say(3)}\n {say(30)}  {passage} {say(25)}\n\n{say(8)}".encode()
            found = paragraph_dedup.paragraphs(text, 8)
            assert all(len(text[a:b].split()) >= 8 and b"\n" not in text[a:b] for a, b, _ in found)
            assert all(text[b:c].strip() == b"" for _, b, c in found) and sum(len(text[a:b].split()) for a, b, _ in found) == 123
            cuts.append({text[a:b] for a, b, _ in found})
        met += bool(cuts[0] & cuts[1])
    assert met >= 270
    assert paragraph_dedup.paragraphs(b"", 8) == paragraph_dedup.paragraphs(b" \n ", 8) == []


def test_paragraphs_of_short_lines(spark):
    """A passage of 60 words in lines of six goes from the second document, whatever short lines stand around it."""
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    verse = lambda n: "\n".join(say(6) for _ in range(n))
    rows, own = [], {}
    for k in range(40):
        passage = say(60).split(" ")
        lines = ["\n".join(" ".join(passage[i : i + 6]) for i in range(0, 60, 6)) for _ in range(2)]
        before = [verse(3), say(5) + "\n\n" + verse(2)]
        rows += [(2 * k + j, before[j] + "\n" + lines[j] + "\n" + verse(3)) for j in range(2)]
        own[2 * k + 1] = set(passage)
    whole = verse(10)
    rows += [(100, whole), (101, whole), (102, "few words\n\nhere\n")]
    out = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["n_dropped"] == 0 and out[i]["text"] == t for i, t in rows if i % 2 == 0)
    assert out[101]["text"].strip() == "" and out[101]["n_dropped"] == out[101]["n_paragraphs"] > 1
    assert sum(out[i]["n_dropped"] > 0 for i in own) >= 36
    text = dict(rows)
    for i in own:
        gone = [w for s in out[i]["spans"] for w in text[i].encode()[s["start"] : s["stop"]].decode().split()]
        assert set(gone) <= own[i]


def test_paragraphs_against_brute_force(spark):
    """Copies, near copies in chains, copies in one text, and unlike paragraphs."""
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    chain = [say(60)]
    for i in range(6):
        chain.append(chain[-1][: 50 - 4 * i] + [f"new{i}"] + chain[-1][51 - 4 * i :])
    common = " ".join(say(55))
    texts = [" ".join(say(30)) + "\n" + " ".join(c) + "\n" + " ".join(say(8)) for c in chain] + [common + "\n" + common.upper(), "x\n  " + common, common] + [" ".join(say(40)) for _ in range(10)]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)] + [(None, common)], "doc_id long, text string")

    def shingle_set(line):
        w = line.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    cut = lambda t: [t[a:b] for a, b, _ in paragraph_dedup.paragraphs(t.encode(), 8)]
    at = [(d is None, d or 0, i, shingle_set(x)) for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()] for i, x in enumerate(cut(t))]
    root = list(range(len(at)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(at)):
        for j in range(i):
            if 100 * len(at[i][3] & at[j][3]) >= 80 * len(at[i][3] | at[j][3]):
                root[top(i)] = top(j)
    first = {}
    for i, p in enumerate(at):
        first[top(i)] = min(first.get(top(i), p[:3]), p[:3])
    gone = {p[:3] for i, p in enumerate(at) if p[:3] != first[top(i)]}
    assert len(gone) >= 10
    for row, text in [(r, (docs.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).first()["text"])) for r in paragraph_dedup.dedup_paragraphs(docs).collect()]:
        key = (row["doc_id"] is None, row["doc_id"] or 0)
        lines = cut(text)
        left = [x for i, x in enumerate(lines) if (*key, i) not in gone]
        short = ["x"] if text.startswith("x\n") else []
        assert row["text"].split() == short + [w for x in left for w in x.split()]
        assert row["n_dropped"] == sum((*key, i) in gone for i in range(len(lines))) and row["n_bytes"] == len(text.encode())
        assert sum(len(text.encode()[s["start"] : s["stop"]].split()) for s in row["spans"]) == sum(len(x.split()) for i, x in enumerate(lines) if (*key, i) in gone)


def test_paragraphs_of_many_texts_at_once():
    """Texts that are cut and hashed together have the paragraphs and shingles that each has by itself."""
    r = random.Random(12)
    texts = ["\n".join(" ".join(f"W{r.randrange(50)}" for _ in range(r.randrange(14))) for _ in range(r.randrange(6))).encode() for _ in range(300)]
    texts += [b"", b" \n", b"one two three four\n", b"five six seven eight nine\n\nten"]
    for min_words in (1, 3, 8):
        alone = [paragraph_dedup.paragraphs(t, min_words) for t in texts]
        assert paragraph_dedup.paragraphs_of(texts, min_words) == alone
        words = shingles.Words(texts)
        at, to, _ = paragraph_dedup._cut(words, min_words)
        flat, starts = words.sets(at, to, 5)
        want = list(shingles.shingles([t[a:b] for t, found in zip(texts, alone, strict=True) for a, b, _ in found], 5))
        assert [s.tolist() for s in np.split(flat, starts[1:])] == [s.tolist() for s in want]


def test_paragraphs_bands_are_shuffled_by_name(spark, monkeypatch):
    """What is written beside the paragraphs themselves: of bands only those of several nodes, and no key is repeated for each salt."""
    r = random.Random(13)
    say = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    common = say(30)
    docs = spark.createDataFrame([(i, f"{say(60)}\n{common}") for i in range(60)], "doc_id long, text string")
    saved = {}

    def save(df, label, *more):
        out = kept(df, label, *more)
        saved[label] = (out.columns, out.count())
        return out

    kept = paragraph_dedup.save
    monkeypatch.setattr(paragraph_dedup, "save", save)
    monkeypatch.setattr(paragraph_dedup, "BROADCAST_ROWS", 0, raising=False)
    out = {x["doc_id"]: x for x in paragraph_dedup.dedup_paragraphs(docs).collect()}
    assert out[0]["n_dropped"] == 0 and all(out[i]["text"].endswith("\n") and out[i]["n_dropped"] > 0 for i in range(1, 60))
    columns, n = saved["paragraph-bands"]
    assert columns == ["gram", "name"] and n < saved["paragraph-nodes"][1]


def test_paragraphs_met_by_none_are_not_shuffled(spark, monkeypatch):
    """Only paragraphs that share a band with another become nodes."""
    r = random.Random(14)
    say = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    near = say(40)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(x) for x in (say(60), near[:38] + say(1) + near[39:] if i % 20 == 0 else say(40), say(60)))) for i in range(200)], "doc_id long, text string")
    saved = {}

    def save(df, label, *more):
        out = kept(df, label, *more)
        saved[label] = out.count()
        return out

    kept = paragraph_dedup.save
    monkeypatch.setattr(paragraph_dedup, "save", save)
    out = sorted(map(str, paragraph_dedup.dedup_paragraphs(docs).collect()))
    assert 10 <= saved["paragraph-nodes"] < saved["paragraphs"] / 4
    assert sum("n_dropped=0" not in x for x in out) == 9

