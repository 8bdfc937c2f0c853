import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from entitrail.llm import simhash
from entitrail.llm.components import components

from . import cases


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abAB É\t\n\x1c\x85\xa0")), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(fps, most=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def near(r, centre, n, bits):
    out = []
    for _ in range(n):
        x = centre
        for b in r.choice(64, r.integers(0, bits + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def fingerprints():
    r = np.random.default_rng(5)
    random = [int(x) for x in r.integers(0, 1 << 63, 400)]
    found = random + near(r, random[0], 300, 3) + near(r, 0, 40, 6)
    for c in random[1:30]:
        found += near(r, c, 3, 7)
    chain = random[40]
    for b in range(0, 40, 4):
        chain ^= 0b1111 << b
        found.append(chain)
    return found


def test_cells_come_from_the_pivot_table_and_lose_no_link():
    r = np.random.default_rng(7)
    x = r.integers(0, 1 << 64, 500, dtype=np.uint64)
    bits = np.argsort(r.random((500, 64)), axis=1)[:, :4].astype(np.uint64)
    y = x ^ np.bitwise_or.reduce(np.uint64(1) << bits, axis=1)
    table = simhash.pivot_table(x)
    assert (table[:, 0] == np.bitwise_count(x)).all() and (np.abs(table - simhash.pivot_table(y)) <= 4).all()
    for extra in simhash.EXTRA:
        a, b = (simhash.cells(simhash.pivot_table(f), 4 + extra, extra) for f in (x, y))
        assert (a == b).any(axis=1).all()


@pytest.mark.parametrize("most, large", [(20_000, 64), (20, 8), (4, 2)])
def test_links_connect_all(spark, monkeypatch, most, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    found = fingerprints()
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in set(found)]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), 4, most).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    group = plain_components(found)
    root = {f: f for f in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in group} == group


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 103), 100), **dict.fromkeys(range(200, 230), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, expected):
    fp = [(i, plain_fingerprint(t or "")) for i, t in expected]
    group, least = plain_components([f for _, f in fp]), {}
    for i, f in fp:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in rows) == sorted((str(i), f, str(least.get(group[f]))) for i, f in fp)


def test_near_duplicates(spark, sf_dir):
    check(simhash.near_duplicates(cases.frame(spark)).collect(), cases.texts())
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_one_of_each(spark):
    docs = cases.frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and simhash.one_of_each(cases.empty(spark)).count() == 0
    fps = [plain_fingerprint(r.text or "") for r in kept.collect()]
    group = plain_components([plain_fingerprint(t or "") for _, t in cases.texts()])
    assert sorted(group[f] for f in fps) == sorted(set(group.values()))


def test_one_of_each_with_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (1, "quite another text here", "z", 3), (None, "a b c d", "w", 4), (2, "a b c d", "v", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_hash string, KEY_ID int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "quite another text here"), ("None", "a b c d")]
