"""Shards, near-duplicate operators and the pipeline against brute force on small tables."""

import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from gristmill.llm import embedding_dedup, line_dedup, ngram_join, private_data, queries, sharding
from gristmill.llm._shared import staged
from gristmill.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], KIND)


def roots(ids, links):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {i: root(i) for i in ids}


def grams(text, n):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def jaccard_roots(rows, n, percent):
    sets = {d: grams(t, n) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, roots(sets, links)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_ngram_join_whole_table(spark, sf_dir, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes, want = jaccard_roots(rows, 3, 90)
    got = queries.op7_ngram_jaccard(spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (sizes[d], want[d]) for d in sizes}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_ngram_join_of_edited_copies(spark, n, percent):
    rng = np.random.default_rng(n)
    base = [f"w{k}" for k in rng.integers(0, 400, 120)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "A b"), (4, "a  B"), (5, "a b c"), (6, "x y z")]
    for k in range(10, 60):
        words = list(base[: int(rng.integers(60, 121))])
        for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
            words[at] = f"v{int(rng.integers(0, 3))}"
        rows.append((k, " ".join(words)))
    sizes, want = jaccard_roots(rows, n, percent)
    given = frame(spark, rows)
    got = ngram_join.jaccard_components(given, n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (sizes[d], want[d]) for d in sizes}
    kept = ngram_join.keep_one_of_each(given, n=n, percent=percent)
    assert kept.columns == given.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_ngram_join_of_odd_rows(spark):
    given = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")])
    got = sorted(map(repr, ((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(given, n=3, percent=90).collect())))
    assert got == sorted(map(repr, [(1, 1), (1, 1), (None, None), (2, 1)]))
    assert ngram_join.jaccard_components(given.limit(0)).count() == 0


def test_prefix_tree_finds_what_brute_force_does():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(80)]
    tree = ngram_join.PrefixTree(list(enumerate(sets)))
    for probe in sets:
        want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 70 * len(np.union1d(probe, s))}
        assert set(tree.similar(probe, 70, step=4)) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({i for pair in links for i in pair}, links)
    assert got == {i: r for i, r in want.items() if i != 5}


def lines_gone(rows):
    seen, gone = [], {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            words = WORDS.findall(line)
            tokens = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
            if 0 < len(words) < 5 and any(c.isalnum() for c in line):
                tokens = {tuple(words)}
            if tokens:
                gone[d, k] = any(len(tokens & s) * 100 >= 80 * len(tokens | s) for s in seen)
                seen.append(tokens)
            else:
                gone[d, k] = False
    return gone


def test_line_dedup_whole_table(spark, sf_dir, docs):
    want = lines_gone([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {(r["doc_id"], k): str(k) in r["removed"].split(",") for r in queries.op10_line_dedup(spark, sf_dir).collect() for k in range(r["n_lines"])}
    assert got == want


def test_line_dedup_of_edited_lines(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(40)]
    rows = [(-3, None), (-2, ""), (-1, "short line\n\nshort line")]
    for d in range(150):
        lines = []
        for _ in range(3):
            words = list(base[: int(rng.integers(25, 41))])
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[at] = f"x{int(rng.integers(0, 5))}"
            lines.append(" ".join(words))
        rows.append((d, "\n".join(lines)))
    given = frame(spark, rows)
    got = {(r["doc_id"], r["line"]): r["gone"] for r in line_dedup.line_decisions(given).collect()}
    assert got == lines_gone(rows)
    left = line_dedup.dedup_lines(given)
    assert left.columns == given.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())
    assert {-3, -2, -1, 0} <= {r["doc_id"] for r in left.collect()}


def test_line_dedup_orders_tokens_of_common_passages(spark):
    """Lines that share a long passage but aren't similar: none may go, though all share most tokens."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(d, passage + " " + " ".join(f"d{d}x{k}" for k in range(14))) for d in range(200)]
    assert not any(r["gone"] for r in line_dedup.line_decisions(frame(spark, rows)).collect())


def test_line_dedup_of_lines_of_few_words(spark):
    """A line of fewer than five words is compared as a whole, so its copies go; bare marks and blank lines stay."""
    han, thai, kana = "本文经授权转载自公众号，未经许可不得转载。", "สงวนลิขสิทธิ์ทุกประการ", "すべての 権利を 保有します"
    lines = [han, thai, kana, "https://example.org/" + "a/" * 20, "All rights reserved.", "日本", "Home", "}", "--- --", " ", ""]
    rows = [(d, "\n".join(lines)) for d in range(3)] + [(3, f"  {han}\t"), (4, han[:-1]), (5, "All  rights reserved.\r"), (6, "all rights reserved."), (7, "rights All reserved.")]
    got = {(r["doc_id"], r["line"]) for r in line_dedup.line_decisions(frame(spark, rows)).collect() if r["gone"]}
    assert got == {(d, k) for d in (1, 2) for k in range(7)} | {(3, 0), (5, 0)}


def test_line_dedup_with_more_common_tokens_than_its_table_holds(spark, monkeypatch):
    """Where the topmost level of commonness alone overflows the table, a share of it orders the tokens; no row is lost."""
    monkeypatch.setattr(line_dedup, "COMMON", 100)
    passage = " ".join(f"p{k}" for k in range(300))
    rows = [(d, f"{passage} d{d}a d{d}b d{d}c") for d in range(80)] + [(d, f"{passage} " + " ".join(f"e{d}x{k}" for k in range(400))) for d in range(80, 160)]
    got = {(r["doc_id"], r["line"]): r["gone"] for r in line_dedup.line_decisions(frame(spark, rows)).collect()}
    assert got == lines_gone(rows)


def test_line_dedup_keeps_columns_whatever_their_names(spark):
    given = frame(spark, [(1, "one two three four five"), (2, "one two three four five\nsix seven eight nine ten")])
    named = given.selectExpr("*", "1 AS lost", "2 AS gone_id", "3 AS __lost", "4 AS line", "5 AS gone")
    left = line_dedup.dedup_lines(named)
    assert left.columns == named.columns and [(r["text"], r["lost"], r["gone"]) for r in left.orderBy("doc_id").collect()] == [("one two three four five", 1, 5), ("six seven eight nine ten", 1, 5)]


def test_line_dedup_of_odd_rows(spark):
    line = "one two three four five six"
    got = line_dedup.line_decisions(frame(spark, [(1, line), (1, line), (None, line), (2, line + "\n" + line)])).collect()
    assert {(r["doc_id"], r["line"], r["gone"]) for r in got} == {(None, 0, False), (1, 0, True), (2, 0, True), (2, 1, True)}
    assert line_dedup.line_decisions(frame(spark, [(1, line)]).limit(0)).count() == 0


def against_brute_force(vectors, got, threshold=0.93):
    """Share of the links found; no link is made up, and components are those of the links found or of all."""
    unit = {v: np.array(e, float) / np.linalg.norm(e) for v, e, _ in vectors}
    label = {v: k for v, _, k in vectors}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if label[a] is not None and label[a] == label[b] and unit[a] @ unit[b] >= threshold]
    want = dict.fromkeys(unit, 0)
    for a, b in links:
        want[a] += 1
        want[b] += 1
    assert got.keys() == unit.keys() and all(got[v]["n_links"] <= want[v] for v in want)
    whole = roots(unit, links)
    assert all(whole[r["component_id"]] == whole[v] and r["component_id"] <= v for v, r in got.items())
    assert all(r["kept"] == (v == r["component_id"]) for v, r in got.items())
    same = sum(r["component_id"] == whole[v] for v, r in got.items())
    return sum(r["n_links"] for r in got.values()), sum(want.values()), same / len(unit)


def test_embeddings_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found, all_, same = against_brute_force(rows, {r["vec_id"]: r for r in queries.op4_embedding_dedup(spark, sf_dir).collect()})
    assert found >= 0.9 * all_ and same >= 0.9


@pytest.mark.parametrize("codewords", [None, 40])
def test_recall_of_planted_embeddings(spark, codewords):
    """Pairs and groups turned from a random vector by cosines around the threshold: at least 0.9 of the links are found."""
    rng, rows = np.random.default_rng(11), []
    for _ in range(450):
        source = rng.normal(size=64)
        source /= np.linalg.norm(source)
        for _ in range(int(rng.integers(1, 5))):
            noise = rng.normal(size=64)
            noise -= (noise @ source) * source
            cosine = rng.uniform(0.9, 1.0)
            v = cosine * source + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.5, 2)], int(rng.integers(0, 2)) if rng.random() < 0.1 else 0))
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(given, codewords=codewords).collect()}
    found, all_, same = against_brute_force(rows, got)
    assert all_ > 400 and found >= 0.9 * all_ and same >= 0.9


def test_odd_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0] * 3, 0), (6, [1.0, math.nan, 2.0], 0), (7, [1.0, None, 2.0], 0), (8, v, 1), (9, [], 0), (None, v, 0), (10, [-1.0, 5.0, 0.1], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert (by[1]["n_links"], by[2]["n_links"], by[2]["component_id"], by[1]["kept"], by[2]["kept"]) == (3, 3, 1, True, False)
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in (3, 4, 5, 6, 7, 8, 9, 10)) and not by[None]["kept"]
    near = [v[0], v[1], v[2] + 0.01]
    rows = [(None, v, 0), (None, near, 0), (7, [v[0], v[1] + 0.01, v[2]], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [("7", 2, 7, True), ("None", 2, None, False), ("None", 2, None, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_shards(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op2_best_fit_shards(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots, of_text, mass = {}, {}, dict.fromkeys(range(40), 0)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert of_text.setdefault(raw, r["shard"]) == r["shard"]
        mass[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    largest = max(sum(r["size"] for r in rows if (texts[r["doc_id"]] or "").encode() == raw) for raw in of_text)
    assert max(mass.values()) <= max(largest, 1.02 * sum(mass.values()) / 40) and min(mass.values()) > 0


def test_shards_of_many_documents_are_of_near_equal_bytes(spark, tmp_path):
    rng = np.random.default_rng(8)
    given = frame(spark, [(k, f"t{k} " + "x" * int(rng.integers(0, 900))) for k in range(3_000)] + [(9_000 + k, "same text " * 300) for k in range(5)])
    placed = sharding.assign_shards(given, 10)
    mass = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes").collect()}
    assert len(mass) == 10 and max(mass.values()) <= 1.01 * sum(mass.values()) / 10
    sharding.write_shards(given, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == given.count() and {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}
    few = sharding.assign_shards(given, capacity=40_000)
    full = [r["sum(size)"] for r in few.groupBy("shard").agg({"size": "sum"}).collect()]
    assert max(full) <= 40_000 and len(full) <= 1.05 * sum(full) / 40_000 + 1


def test_best_fit_is_that_of_single_steps():
    rng = np.random.default_rng(2)
    for _ in range(50):
        histogram = [(int(s), int(rng.integers(1, 5))) for s in rng.choice(np.arange(1, 60), 12, replace=False)]
        room, bins = [], []
        for size, count in sorted(histogram, reverse=True):
            for _ in range(count):
                fits = [k for k in range(len(room)) if room[k] >= size]
                k = min(fits, key=lambda j: (room[j], j)) if fits else len(room)
                if not fits:
                    room.append(60)
                room[k] -= size
                bins.append((size, k))
        got = [(s, b) for s, lo, hi, b in sharding.best_fit(histogram, 60) for _ in range(hi - lo)]
        assert Counter(got) == Counter((s, b) for s, b in bins)  # the same sizes in the same bins


def test_odd_shards(spark):
    given = frame(spark, [(1, None), (2, None), (3, "a"), (3, "a"), (None, "b")])
    rows = sharding.assign_shards(given, 3).collect()
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["size"] == 16}) == 1
    assert sharding.assign_shards(given.limit(0), 3).count() == 0


def test_pipeline_stages_are_their_operators(spark, sf_dir, docs):
    """Each stage against a plain reckoning of what it does, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    told = staged(stages["language_id"](spark, docs, sf_dir), "test-told")
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(unicodedata.category(c)[0] == "L" for c in r["text"])}
    assert {r["doc_id"] for r in told.collect()} == lettered
    cleaned = staged(stages["line_dedup"](spark, told, sf_dir), "test-cleaned")
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    gone, want = lines_gone(rows), {}
    for d, text in rows:
        left = [line for k, line in enumerate(text.split("\n")) if not gone[d, k]]
        if not any(gone[d, k] for k in range(text.count("\n") + 1)) or any(WORDS.search(x) for x in left):
            want[d] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == want
    one = staged(stages["ngram_jaccard"](spark, cleaned, sf_dir), "test-one")
    assert {r["doc_id"] for r in one.collect()} == set(jaccard_roots(list(want.items()), 5, 80)[1].values())
    private = {r["doc_id"]: r["text"] for r in stages["private_data"](spark, one, sf_dir).collect()}
    for r in one.collect():
        found = private_data.find(r["text"])
        assert (private[r["doc_id"]] == r["text"]) == (not found)
        assert not any(kind in ("email", "phone", "ip") and r["text"][a:b] in private[r["doc_id"]] for a, b, kind, _ in found)
    assert told.columns == cleaned.columns == one.columns == docs.columns
    assert 0.5 * docs.count() < len(private) <= len(want) <= len(lettered)
    pieces = corpus_pipeline.STAGES[-1][1](spark, one, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(private)


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Null ids, null and empty texts, repeated rows, a very long text, and an empty table go through all stages."""
    line = "the river runs along the old town and the people walk there in the evening"
    rows = [(None, line + " with no id"), (1, None), (2, ""), (3, line), (3, line), (4, "Mr Smith wrote to a@b.org about the long river and its many people"), (5, " ".join(f"w{k % 7_000}" for k in range(120_000)))]
    given = frame(spark, rows)
    for now in (given, given.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, sf_dir), f"odd-{name}")
        ids = {r["doc_id"] for r in now.collect()}
        assert ids in (set(), {None, 3, 4, 5})


def test_pipeline_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "private_data", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    """Queries that SQL can say, against that SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = lambda table: sorted((tuple(r[n] for n in sorted(table.column_names)) for r in table.to_pylist()), key=repr)
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toArrow(), con.execute(queries.ORACLE[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names) and rows(ours) == rows(theirs)


def test_ngram_keys_of_texts_that_collide_in_polynomials(spark):
    """Thue-Morse words and their complements have one polynomial modulo 2**64, whatever the odd base."""
    for size in (10, 11, 12):
        bits = [bin(k).count("1") % 2 for k in range(1 << size)]
        one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
        got = ngram_join.jaccard_components(frame(spark, [(1, one), (2, other), (3, one)]), n=3, percent=90).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_ngram_keys_tell_words_apart():
    words = sorted({b"a" * k for k in range(1, 40)} | {b"a" * k + b"\0" * j for k in range(9) for j in range(9)} | {bytes([k]) for k in range(256)} | {b"x" * k for k in (1_023, 1_024, 1_025, 5_000)} | {str(k).encode() for k in range(20_000)})
    assert len(set(ngram_join._word_hashes(words).tolist())) == len(words)
    assert (ngram_join._word_hashes(words) == np.array([ngram_join._word_hashes([w])[0] for w in words])).all()
    assert len({ngram_join.ngram_keys(t, 3).tobytes() for t in ("a b c", "b a c", "a bc", "ab c", "abc", "c b a", "a b", "a a a", "a a")}) == 9
    assert ngram_join.ngram_keys("A  b\tC", 3).tolist() == ngram_join.ngram_keys("a b c", 3).tolist()


@pytest.mark.parametrize("n", [2, 4, 10, 20, 50, 100, 400, 700, 1_500])
@pytest.mark.parametrize("cosine", [0.935, 0.999])
def test_recall_of_planted_pairs_at_every_size(n, cosine):
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    one = unit(rng.normal(size=(n // 2, 64)))
    away = rng.normal(size=one.shape)
    away = unit(away - (away * one).sum(1)[:, None] * one)
    both = np.concatenate([one, cosine * one + math.sqrt(1 - cosine**2) * away])
    index = embedding_dedup.MultiIndex(both[: embedding_dedup.SAMPLE], 0.93, embedding_dedup.codewords_for(n))
    homes, (d1, d2) = index.cells(both), index.spread(both)
    visits = [set(embedding_dedup.traverse(a, b, index.visits)) | {tuple(h)} for a, b, h in zip(d1, d2, homes.tolist())]
    half = n // 2
    met = np.mean([tuple(homes[k + half]) in visits[k] or tuple(homes[k]) in visits[k + half] for k in range(half)])
    assert met == 1 if n <= embedding_dedup.BLOCK else met >= 0.95


def test_few_vectors_and_a_rare_dimension_link(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [1.0, 0.0, 0.001], 1), (2, [1.0, 0.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.01, 1.0], 1)] + [(10 + k, v.tolist(), 1) for k, v in enumerate(rng.normal(size=(900, 16)))]
    for table in (rows[:2], rows[:4], rows):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
        assert got[1] == (1, 1) and got[2] == (1, 1) and (len(table) < 4 or got[3] == got[4] == (1, 3))
