"""The pipeline stage by stage, on planted copies, near copies and leaks, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm.helpers import clashing, odd_documents
from llm.test_text import reference_encoding

import corpus_pipeline
from tidewright.llm import common, decontaminate, quality

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@pytest.fixture(scope="module")
def home(spark, sf, tmp_path_factory):
    """Documents of the test data with copies in other case, near copies and benchmark items in them."""
    at = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(21)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r[c] for c in docs.columns) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    place = {c: k for k, c in enumerate(docs.columns)}
    long = [r for r in rows if r[place["text"]] and 120 <= len(r[place["text"]].split()) <= 400]

    def planted(r, key, text):
        own = list(r)
        own[place["doc_id"]], own[place["text"]] = key, text
        return tuple(own)

    more = []
    for k, r in enumerate(long[:12]):
        words = r[place["text"]].split()
        more.append(planted(r, 900_000 + k, r[place["text"]].swapcase() if k % 2 else r[place["text"]]))
        edited = list(words)
        edited[rnd.randrange(len(words))] = "changed"
        more.append(planted(r, 910_000 + k, " ".join(edited)))
        more.append(planted(r, 920_000 + k, " ".join(words + ["word%d" % x for x in range(len(words) // 6)])))
        more.append(planted(r, 930_000 + k, " ".join(words[: len(words) // 2] + [items[k % len(items)]] + words[len(words) // 2 :] + ["other%d" % x for x in range(len(words))])))
    spark.createDataFrame(rows + more + [planted(rows[0], 940_000, None), planted(rows[0], 940_001, "")], docs.schema).write.parquet(f"{at}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, home):
    """What each stage got and what it kept."""
    docs, out = spark.read.parquet(f"{home}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = common.cut(stage(spark, docs, home), name)
        out[name] = (docs, kept)
        docs = kept
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_return_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))


def test_quality_keeps_what_the_model_says(spark, home, stages):
    before, after = stages["quality"]
    model = quality.train(before, spark.read.parquet(f"{home}/labels.parquet"))
    assert set(texts(after)) == {k for k, t in texts(before).items() if model.score(t) >= 0.3}


def test_exact_copies_leave_the_largest_id(stages):
    before, after = map(texts, stages["exact_dedup"])
    last = {}
    for k, t in sorted(before.items()):
        last[t.translate(LOWER)] = k
    assert set(after) == set(last.values()) and len(after) < len(before)


def test_near_copies_leave_one_of_each_component(stages):
    before, after = map(texts, stages["near_dedup"])

    def shingles(t):
        w = t.translate(LOWER).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = sorted((k, shingles(t)) for k, t in before.items())
    root = {k: k for k in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i, (k, x) in enumerate(sets):
        for m, y in sets[:i]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                near += 1
                a, b = find(k), find(m)
                root[max(a, b)] = min(a, b)
    assert near > 15 and set(after) == {k for k in before if find(k) == k}


def test_leaks_go_and_the_rest_stays(spark, home, stages):
    """Myers' distance over whole texts, without any pieces."""
    before, after = map(texts, stages["decontaminate"])
    items = {decontaminate.normalised(r["text"] or "") for r in spark.read.parquet(f"{home}/benchmark.parquet").collect()} - {""}
    assert all(len(x) >= decontaminate.PIECE for x in items)

    def leaks(t):
        t = decontaminate.normalised(t)
        return any(x in t or min(decontaminate.distances(x, t), default=len(x)) <= decontaminate.budget(len(x)) for x in items)

    some = {k for k, t in before.items() if k >= 900_000 or len(t) < 1500}
    assert {k for k in some if k not in after} == {k for k in some if leaks(before[k])}
    gone = {k for k in before if k not in after}
    assert any(k >= 930_000 for k in gone) and not any(k >= 930_000 for k in after if k < 940_000)


def test_tokens_are_those_of_the_ranks(stages):
    before, after = stages["tokenize"]
    known, text = reference_encoding(), texts(before)
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(text)
    for r in rows:
        ids = known.encode_ordinary(text[r["doc_id"]])
        assert np.frombuffer(bytes(r["ids_le"]), "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_is_all_stages_and_leaves_its_result_alone(spark, home, stages):
    got = corpus_pipeline.run(spark, home)
    want = stages["tokenize"][1]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stages_take_odd_and_empty_tables(spark, home):
    docs = clashing(odd_documents(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, home)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), home).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, home).count() == docs.count()


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    with common.scratch(spark):
        a = common.cut(spark.range(3).toDF("x"), "a")
        with common.scratch(spark):
            b, c = common.cut(a, "b"), common.keep(common.cut(a, "c"))
        assert not os.path.exists(b._cut_path) and c.count() == 3
        d = common.keep(common.cut(c, "d"))
    assert not os.path.exists(a._cut_path) and not os.path.exists(c._cut_path) and d.count() == 3
    common.drop_cut(d)
    assert not os.path.exists(d._cut_path)
