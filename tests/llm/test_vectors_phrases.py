"""Lloyd rounds, collocations and graph search against SQL and brute force, and their odd rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from gristmill.llm import collocations, hnsw, lloyd, queries

KIND = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("name", ["op11_lloyd", "op12_collocations"])
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table_against_sql(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, folder).toPandas()
    theirs = con.execute(queries.ORACLE[name]).df()
    assert len(ours) and list(ours.columns) == list(theirs.columns)
    assert sorted(map(tuple, ours.to_numpy().tolist())) == sorted(map(tuple, theirs.to_numpy().tolist()))


def lloyd_by_hand(rows, k, rounds, dimension, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    codes = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(codes))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        codes = [[sum(v[d] for v in some) // len(some) for d in range(dimension)] if (some := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else codes[c] for c in range(len(codes))]
    last = [(i, *near(v)) for i, v in kept]
    apart = Counter()
    for _, d, c in last:
        apart[c] += d
    top = lambda x: min(x, 2**63 - 1)
    return sorted(((i, c, top(d), top(apart[c]), top(sum(apart.values())), hashlib.sha256(",".join(map(str, codes[c])).encode()).hexdigest()) for i, d, c in last), key=repr)


@pytest.mark.parametrize("big", [1.0, 1e7, 1e15])
def test_lloyd_odd_rows(spark, big):
    rng = np.random.default_rng(5)
    rows = [(k, (big * rng.normal(size=3).round(1)).tolist()) for k in range(60)]
    rows += [(3, rows[3][1]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (-7, [0.0, -0.0, 0.0]), (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 0.0]), (104, [math.inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1.0] * 4)]
    given = spark.createDataFrame([(i, v, 1, 9) for i, v in rows], KIND + ", cluster int").repartition(5)
    for k, rounds in ((4, 3), (1, 1), (200, 2)):
        got = lloyd.lloyd(given, k=k, rounds=rounds, dimension=3, scale=64).collect()
        assert sorted((tuple(r) for r in got), key=repr) == lloyd_by_hand(rows, k, rounds, 3, 64)


def test_lloyd_empty_and_beyond_longs(spark):
    assert lloyd.lloyd(spark.createDataFrame([], KIND)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = lloyd.lloyd(spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [1.0, 0.0], 0)], KIND), dimension=2).collect()
    assert [r["vec_id"] for r in got] == [2]


def phrases_by_hand(rows, max_words=3, min_count=10, percent=50, limit=2000):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, max_words + 1) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for (lang, *ws), a in found.items():
        score, _, left, right = min((1_000_000 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k, f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws)))
        inside = any(q[0] == lang and len(q) - 1 > len(ws) and 100 * b >= percent * a and any(list(q[i : i + len(ws)]) == ws for i in range(1, len(q))) for q, b in found.items())
        if not inside:
            out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k, *r[1:]) for k, r in enumerate(own[:limit], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("max_words, min_count, chunk_words", [(3, 10, 1 << 21), (3, 2, 40), (2, 3, 7), (5, 2, 200)])
def test_collocations_of_odd_texts(spark, max_words, min_count, chunk_words):
    rng = np.random.default_rng(max_words)
    vocabulary = ["ab", "AB", "Ñu", "ñu", "x", "y-z", " ", "日本", "a\x00b", "q\x1c"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? ", "\x0b"]
    texts = ["".join(str(rng.choice(vocabulary)) + str(rng.choice(marks, p=[0.6, 0.1, 0.1, 0.04, 0.04, 0.03, 0.03, 0.03, 0.03])) for _ in range(rng.integers(0, 60))) for _ in range(80)]
    texts += ["ab ab ab ab ab ab", "one two three " * 3_000, "", "...", "   ", None, texts[0], texts[0]]
    rows = [([None, "en", "de", "und"][k % 4], t) for k, t in enumerate(texts)]
    given = spark.createDataFrame([(k, t, lang, "s", k, 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, chunk string, n long, f int").repartition(3)
    got = collocations.collocations(given, max_words=max_words, min_count=min_count, chunk_words=chunk_words).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, max_words, min_count)


def test_collocations_empty_and_slices(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    text = b"one two. three, four five six seven eight; nine"
    for size in (1, 5, 20, 100):
        parts = list(collocations.slices(text, size))
        assert b"".join(parts) == text.translate(collocations.BYTES)
        assert all(p.startswith(collocations.MARK) for p in parts[1:])


def nearest_by_hand(rows, every, k):
    fit = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, v in sorted(fit, reverse=True):
        if q % every == 0:
            a = hnsw.prepared(np.array([v]))
            out[q] = sorted((-float(hnsw.cosines(a, hnsw.prepared(np.array([w])))[0]), i) for i, w in fit if i != q and len(w) == len(v))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_graph_recall_on_whole_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = nearest_by_hand(rows, 50, 5), answers(queries.op13_hnsw(spark, folder))
    assert want.keys() == got.keys() and all(len(got[q]) == 5 for q in want)
    scores = {q: dict((i, s) for s, i in nearest_by_hand([(q, dict(rows)[q]), *[(i, v) for i, v in rows if i in {x for _, x in got[q]}]], 50, 9)[q]) for q in list(want)[:5]}
    assert all(abs(scores[q][i] - s) < 1e-12 for q in scores for s, i in got[q])
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) / 5 for q in want]) >= 0.95


def test_graph_recall_over_shards_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    points = centres[rng.integers(0, 8, 1_500)] + 0.05 * rng.normal(size=(1_500, 16))
    points[200:600] = points[200]  # a large group of copies
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    given = spark.createDataFrame([(i, v, 1) for i, v in rows], KIND)
    want, got = nearest_by_hand(rows, 10, 5), answers(hnsw.nearest(given, every=10, k=5, shard_rows=300))
    assert want.keys() == got.keys()
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) / 5 for q in want]) >= 0.95
    assert [i for _, i in got[250]] == [200, 201, 202, 203, 204]


def test_graph_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [1e200, 1e200]), (3, [-1e-200, 0.0]), (-50, [1.0, 1.0]), (None, [1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [math.nan, 1.0]), (9, [None, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [math.inf, 0.0])]
    given = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND + ", score string")
    want = nearest_by_hand(rows, 50, 5)
    got = answers(hnsw.nearest(given, every=50, k=5))
    assert set(got) == {0, -50}  # the only vector of three numbers meets none
    assert [(i, round(s, 12)) for s, i in got[-50]] == [(i, round(s, 12)) for s, i in want[-50]]
    assert got[0] == sorted((-float(hnsw.cosines(hnsw.prepared(np.array([[0.0, 1.0]])), hnsw.prepared(np.array([v])))[0]), i) for i, v in ((1, [2.0, 0.0]), (2, [1e200, 1e200]), (3, [-1e-200, 0.0]), (-50, [1.0, 1.0])))
    assert hnsw.nearest(spark.createDataFrame([], KIND)).collect() == []


def test_graph_of_many_sizes_reaches_all():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 40, 700):
        unit = hnsw._unit(rng.normal(size=(n, 8)))
        graph, order = hnsw.Graph.built(unit)
        assert sorted(order.tolist()) == list(range(n)) and np.array_equal(graph.vectors, unit[order])
        found = graph.search(unit[:20], n)
        assert all(sorted(f.tolist()) == list(range(n)) for f in found)
