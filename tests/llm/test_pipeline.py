"""Pipeline stages against brute force, each on its own input."""

import random

import pytest

import corpus_pipeline as cp
from test_decontaminate import brute as brute_hits
from test_jaccard_join import brute as brute_groups
from test_native_and_web import brute_base


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(name, input, output) of every stage; the input holds planted cases beside the given table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rnd = random.Random(3)
    rows = docs.collect()
    clean = [r for r in rows if r.n_chars > 600][:8]
    extra = []
    for k, r in enumerate(clean):
        words = r.text.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        extra.append((90000 + k, " ".join(words), r.lang, r.source, 1))
        extra.append((91000 + k, r.text + " " + bench[k].text, r.lang, None, 1))
        extra.append((92000 + k, f"{r.text} password = Zk9vQ2x7Lr4TnW8yHs3Bd6{k}", r.lang, r.source, 1))
    extra += [(None, None, None, None, None), (93000, "", "en", "src1", 0), (90000, extra[0][1], *extra[0][2:])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out, folder = [], tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(cp.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def test_columns(spark, sf, stages):
    want = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _ in cp.STAGES] == list(stages)
    assert all(b.columns == want for _, b in list(stages.values())[:-1])


def test_quality_keeps_clean_documents(spark, sf, stages):
    before, after = stages["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    clean = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1]
    junk = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i in kept for i in junk) <= 0.3 * len(junk)


def test_one_of_each_group(stages):
    before, after = stages["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    groups = {}
    for i, n, c in brute_groups(rows):
        groups.setdefault(("none", i) if n == 0 else c, []).append(i)
    got = sorted((r.doc_id for r in after.collect()), key=str)
    assert got == sorted((i if isinstance(g, tuple) else g for g, ids in groups.items() for i in ids[:1]), key=str)


def test_no_benchmark_window_is_left(spark, sf, stages):
    before, after = stages["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = sorted((r[0] for r in brute_hits([(r.doc_id, r.text) for r in before.collect()], items) if not r[5]), key=str)
    assert sorted((r.doc_id for r in after.collect()), key=str) == clean
    assert len(clean) < before.count()


def test_secrets_are_replaced(stages):
    before, after = stages["secret_scans"]
    was = {r.doc_id: r for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(was)
    for r in rows:
        assert brute_base(r.text)[:3] == (0, 0, 0)
        assert r.n_chars == (None if r.text is None else len(r.text))
        if sum(brute_base(was[r.doc_id].text)[:3]) == 0 and r.text is not None:
            assert r.text == was[r.doc_id].text or "[SECRET]" in r.text


def test_mix(stages):
    before, after = stages["source_mixing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
    total = {}
    for r in rows:
        assert 0 < r.taken <= 2 * r.size
        total.setdefault((r.source, r.target), []).append(r.taken)
    assert all(t - 1 <= sum(v) <= t for (_, t), v in total.items())


def test_run_is_the_chain_of_stages(spark, sf):
    rows = cp.run(spark, sf).collect()
    again = cp.run(spark, sf).collect()
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


EXTRA = ("score", "predicted", "held_out", "spans", "items", "n_words", "n_hit", "novelty", "redacted", "kept", "row", "row_key", "key", "id", "body",
         "label", "component", "range", "weight", "a.b", "tie")


def awkward(spark, like):
    """Null, empty, repeated and very long rows under the columns of documents and more of clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(200_000))
    base = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "   ", None, "s", 3), (4, "a short text", "en", "s", 12), (4, "a short text", "en", "s", 12),
            (5, long, "en", "t", len(long)), (6, long, "en", "t", len(long)), (None, None, None, None, None), (7, "line\n" * 3000, "en", "t", 15000),
            (8, 'password = "Zk9vQ2x7Lr4TnW8yHs3Bd6"', "en", "t", 5)]
    df = spark.createDataFrame(base, like)
    for c in EXTRA:
        df = df.withColumn(c, cp.F.lit("own"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_every_stage_takes_awkward_rows_and_clashing_names(spark, sf, name):
    like = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs, stage = awkward(spark, like), dict(cp.STAGES)[name]
    got = stage(spark, docs, sf)
    rows = got.collect()
    ids = sorted(str(r["doc_id"]) for r in rows)
    if name == "source_mixing":
        assert set(ids) <= {"4", "5", "6", "7", "8", "3"} and stage(spark, docs.limit(0), sf).count() == 0
        return
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == like["n_chars"].dataType
    assert all(r[c] == "own" for r in rows for c in EXTRA)
    every = sorted(str(r["doc_id"]) for r in docs.collect())
    want = {"benchmark_decontamination": every, "secret_scans": every, "ngram_jaccard_join": ["1", "2", "3", "4", "5", "7", "8", "None"]}
    assert set(ids) <= set(every) if name == "quality_classifier" else ids == want[name]
    if name == "secret_scans":
        assert "Zk9v" not in next(r["text"] for r in rows if r["doc_id"] == 8) and next(r["text"] for r in rows if r["doc_id"] == 1) is None
    assert stage(spark, docs.limit(0), sf).count() == 0 and stage(spark, docs.drop("n_chars", *EXTRA), sf).columns == ["doc_id", "text", "lang", "source"]
