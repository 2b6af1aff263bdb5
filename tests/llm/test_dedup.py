import random

import numpy as np
import pytest
from llm.helpers import clashing, odd_documents

from tidewright.llm import exact_dedup, simhash
from tidewright.llm.components import connected_components
from tidewright.llm.exact_dedup import drop_exact_copies, exact_groups

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_groups(rows):
    by = {}
    for k, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(k)
    out = []
    for k, t in rows:
        own = by[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((k, keep, len(own), k == keep))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_groups_of_odd_rows(spark, extra):
    docs = odd_documents(spark)
    docs = clashing(docs) if extra else docs
    got = exact_groups(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == brute_groups(rows)
    assert exact_groups(docs.limit(0)).collect() == []


def test_equal_digests_do_not_stand_for_equal_texts(spark, monkeypatch):
    """With a digest of one value for all, texts still decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "B")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (5, 2), 5: (5, 2), 4: (4, 1)}


def test_drop_exact_copies_keeps_columns_and_one_row(spark):
    docs = clashing(odd_documents(spark))
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for (t,) in docs.select("text").collect()})


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 380)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect() == []


def brute_components(points, radius, most):
    label = list(range(len(points)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(points)):
        d = np.bitwise_count(points[i + 1 :] ^ points[i])
        near = (d[:, 0] <= radius) & (d[:, 1:].sum(1, dtype=int) <= most)
        for j in np.flatnonzero(near) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("radius,parts", [(4, 1), (7, 2), (9, 2), (3, 1)])
def test_masks_cover_every_pair_within_the_radius(radius, parts):
    rnd = random.Random(1)
    masks = simhash.covering_masks(radius, parts)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(radius + 1)))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_components_match_brute_force(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(docs, bucket=bucket).collect()}
    ids = sorted(got)
    label = brute_components(np.array([[int(got[i][0], 16)] for i in ids], np.uint64), 4, 0)
    assert [got[i][1] for i in ids] == [ids[x] for x in label]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in ids[:20]:  # the definition, word by word
        import xxhash

        words = text[i].translate(LOWER).split()
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert int(got[i][0], 16) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_rows(spark):
    docs = clashing(odd_documents(spark))
    got = simhash.components(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert simhash.components(docs.limit(0)).collect() == []
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[2] == 2 and near[5] == 4


def test_near_duplicates_find_edited_copies_and_leave_others(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    originals = [[rnd.choice(vocabulary) for _ in range(300)] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(originals)]
    for k, w in enumerate(originals[:30]):
        own = list(w)
        for at in rnd.sample(range(300), 3):  # fifteen shingles of three hundred
            own[at] = "edited"
        rows.append((100 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sum(got[100 + k] == k for k in range(30)) >= 29
    assert all(got[k] == k for k in range(60))
    assert simhash.drop_near_duplicates(docs).count() <= 61


def jaccard(a, b, size=5):
    x, y = ({tuple(t.split()[k : k + size]) for k in range(max(1, len(t.split()) - size + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_extended_and_shortened_copies_are_candidates(spark):
    """Whole blocks appended or cut away, which move the set of words a lot."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    originals = [[word() for _ in range(200)] for _ in range(120)]
    rows = [(k, " ".join(w)) for k, w in enumerate(originals)]
    rows += [(1000 + k, " ".join(w + [word() for _ in range(45)] if k % 2 else w[:162])) for k, w in enumerate(originals)]
    text = dict(rows)
    assert all(0.8 <= jaccard(text[k], text[1000 + k]) < 0.83 for k in range(120))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {x: x % 1000 for x in text}


@pytest.mark.parametrize("bucket", [4096, 16])
def test_families_of_related_copies_match_brute_force(spark, bucket):
    """Many edited copies of one text, near the similarity: which pairs link is decided for each."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for family, edits in enumerate((3, 4, 5)):
        base = [word() for _ in range(200)]
        for k in range(100):
            own = list(base)
            for at in rnd.sample(range(200), edits):
                own[at] = word()
            rows.append((1000 * family + k, " ".join(own)))
    label = {k: k for k, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [(k, {tuple(t.split()[i : i + 5]) for i in range(196)}) for k, t in rows]
    for i, (k, x) in enumerate(sets):
        for m, y in sets[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                a, b = find(k), find(m)
                label[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=bucket).collect()}
    assert got == {k: find(k) for k, _ in rows}
    assert 10 < len(set(got.values())) < 290


def test_hot_group_of_pages_that_differ_in_a_number(spark):
    """More distinct texts than a bucket holds, nearly all with the same set of words."""
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(248)]
    rows = [(k, " ".join([*words[:100], str(k), *words[100:200], str(7 * k), *words[200:]])) for k in range(600)] + [(9999, "some other page of no group at all")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=32).collect()}
    assert got == {k: 9999 if k == 9999 else 0 for k, _ in rows}


def test_near_duplicates_within_the_radius_need_no_minima(spark, monkeypatch):
    """Covering masks alone find every pair of the similarity whose fingerprints are within the radius."""
    monkeypatch.setattr(simhash, "table_keys", lambda hashes: np.zeros(0, np.uint64))
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    originals = [[word() for _ in range(400)] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(originals)]
    rows += [(1000 + k, " ".join([*w[:200], word(), *w[201:], *(word() for _ in range(k % 9))])) for k, w in enumerate(originals)]
    text, docs = dict(rows), spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = {r["doc_id"]: np.frombuffer(r["point"], ">u8")[2:] for r in simhash.set_points(docs).collect()}
    near = {k for k in range(60) if np.bitwise_count(wide[k] ^ wide[1000 + k]).sum() <= 19}
    assert 30 < len(near) < 60 and all(jaccard(text[k], text[1000 + k]) >= 0.8 for k in near)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert all(got[1000 + k] == k for k in near)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {k for k in text if got[k] == k}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_rows_that_share_a_part_are_told_once(size):
    import pyarrow as pa

    rnd = random.Random(15)
    parts = np.array(sorted(rnd.randrange(400) for _ in range(500)), np.int64)
    table = pa.table({"part": parts, "digest": np.arange(500)})
    got = [tuple(r.values()) for b in simhash._shared(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert got == [(p, k) for k, p in enumerate(parts.tolist()) if (parts == p).sum() > 1]
