import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from entitrail.llm import bpe, packing, simple8b
from entitrail.llm.chunks import IdBytes, library_coder

from . import cases

ANY = st.text(st.sampled_from(list("ab 1'sé ß!\n\t\x1c\x85\xa0日😀Σ́​　İ")), max_size=30)
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def parts(coder, texts):
    flat, sizes = coder.flat(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    return [flat[b - n : b].tolist() for b, n in zip(ends, sizes)]


@pytest.mark.parametrize("name", FILES)
def test_coders_equal_the_library(name):
    whole, coder = library(name), library_coder(P.path(name))
    texts = [t for _, t in cases.texts()]
    assert parts(coder, texts) == [whole(t) for t in texts]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ANY, max_size=4))
    def fuzzed(texts):
        assert parts(coder, texts) == [whole(t) for t in texts]

    fuzzed()


def test_words_are_remembered_by_exact_keys():
    whole, coder = library(FILES[1]), library_coder(P.path(FILES[1]))
    r = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, r.choice([97, 98, 65, 233, 48, 33], r.integers(0, 45)))) for _ in range(60)) for _ in range(40)]
    for _ in range(2):
        assert parts(coder, texts) == [whole(t) for t in texts]
    sliced = pa.array(["skipped", *texts], pa.string()).slice(1)
    flat, sizes = coder.flat(sliced)
    assert flat.tolist() == [i for t in texts for i in whole(t)] and sizes.sum() == len(flat)


def test_chunks_equal_the_whole():
    whole = library(FILES[0])
    plain = IdBytes(lambda texts: [np.array(whole(t), dtype="<u4").tobytes() for t in texts], most=10)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(ANY, max_size=4))
    def fuzzed(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in plain.encode(texts)] == [whole(t) for t in texts]

    fuzzed()


def bpe_of(texts):
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return [coder.encode_ordinary(t or "") for t in texts]


def check_bpe(docs, expected):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.digests(docs, ranks, P.PATTERN).collect()
    want = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), ids in zip(expected, bpe_of([t for _, t in expected]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bpe(spark, sf_dir):
    check_bpe(cases.frame(spark), cases.texts())
    check_bpe(cases.empty(spark), [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_bpe(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_bpe_decodes(spark):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(cases.frame(spark), ranks, P.PATTERN), ranks).collect()
    assert sorted(bytes(r.content) for r in got) == sorted((t or "").encode() for _, t in cases.texts())


def test_bpe_many_small_blocks(spark):
    blocks = bpe.blocks(cases.frame(spark), P.PATTERN, 4, block_words=5)
    assert blocks.where("bucket = -1").count() >= 5
    few = spark.createDataFrame([(i, "same words again " * 100) for i in range(20)], "doc_id long, text string").coalesce(1)
    sizes = [len(r.doc_ids) for r in bpe.blocks(few, P.PATTERN, 4, block_positions=650).where("bucket = -1").collect()]
    assert sum(sizes) == 20 and max(sizes) == 3  # a block ends by positions, however few its words are


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)), max_size=700))
def test_simple8b_words(values):
    v = np.array(values, dtype=np.uint64)
    assert simple8b.decode_words(len(v), *simple8b.encode_words(v)).tolist() == values


def test_simple8b_is_compact():
    for most, words in ((1, 30_000 / 256 * 5 + 1), (1 << 15, 30_000 / 4 * 1.02)):
        v = np.random.default_rng(0).integers(0, most, 30_000).astype(np.uint64)
        assert len(simple8b.encode_words(v)[1]) <= words


def check_ids(spark, docs, expected, path):
    simple8b.write_ids(docs, path, P.path(FILES[1]), file_ids=1000)
    whole = library(FILES[1])
    rows = simple8b.with_starts(simple8b.read_ids(spark, path)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in expected), key=lambda i: (i is not None, i or 0))
    starts = [r.start for r in rows]
    assert starts == [0, *itertools.accumulate(r.n_tokens for r in rows)][: len(rows)]
    want = sorted((-1 if i is None else i, (*whole(t), 2)) for i, t in expected)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want


def test_id_files(spark, sf_dir, tmp_path):
    check_ids(spark, cases.frame(spark), cases.texts(), f"file://{tmp_path}/a")
    check_ids(spark, cases.empty(spark), [], f"file://{tmp_path}/b")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_ids(spark, docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], f"file://{tmp_path}/c")


def test_broken_id_file():
    good = simple8b.file_bytes(0, 0, [1], [3], np.array([1, 2, 3]))
    assert simple8b.File(good).ids().tolist() == [1, 2, 3]
    for bad in (b"x" + good[1:], good[:-9] + b"\n"):
        with pytest.raises(ValueError):
            simple8b.File(bad)


def check_packed(rows, expected):
    whole, sequences, docs = library(FILES[0]), {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        total = 0
        for r in pieces:
            assert r.offset == total and r.length > 0
            total += r.length
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0
    ids = {}
    for i, t in expected:
        ids.setdefault((i, len(whole(t)) + 1), []).append([*whole(t), 1])
    assert ids.keys() == docs.keys()
    for key, texts in ids.items():
        assert sum(r.length for r in docs[key]) == sum(map(len, texts))
        for r in docs[key]:
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for x in texts)


def test_packing(spark, sf_dir):
    tokenizer = P.path(FILES[0])
    check_packed(packing.pack(cases.frame(spark), tokenizer).collect(), cases.texts())
    assert packing.pack(cases.empty(spark), tokenizer).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packed(packing.pack(docs, tokenizer).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(10, 60))
def test_packer(sizes, open_ids):
    out = []
    packer = packing.Packer(16, lambda n, pieces: out.append((n, pieces)), open_ids)
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i, dtype="<u4").tobytes())
    packer.settle(True)
    assert [n for n, _ in out] == list(range(len(out)))
    lengths = [sum(len(x[2]) // 4 for x in pieces) for _, pieces in out]
    assert all(n == 16 or n & (n - 1) == 0 for n in lengths)
    pieces = sorted((i, start, len(ids) // 4) for _, ps in out for i, start, ids, _ in ps)
    covered = {}
    for i, start, n in pieces:
        assert covered.get(i, 0) == start
        covered[i] = start + n
    assert covered == dict(enumerate(sizes))


def test_level_minimises_the_sum_of_squares():
    r = np.random.default_rng(0)
    packer = packing.Packer(12, lambda n, pieces: None)
    for _ in range(300):
        packer.count[1:12] = r.integers(0, 4, 11)
        size = int(r.integers(1, 12))

        def after(h):
            c = packer.count.copy()
            c[h] -= h > 0
            if h + size < 12:
                c[h + size] += 1
            return (c[1:12] ** 2).sum()

        options = [h for h in range(12 - size + 1) if h == 0 or packer.count[h]]
        assert after(packer.level(size)) == min(map(after, options))


def test_settling_early_changes_the_layout_alone():
    """``open_ids`` bounds memory: with any of it, ids lie in one piece each and nothing is padded."""
    sizes = np.random.default_rng(1).integers(1, 40, 500).tolist()
    layouts = []
    for open_ids in (20, 200, 4_000_000):
        out = []
        packer = packing.Packer(16, lambda n, pieces: out.append(pieces), open_ids)
        for i, n in enumerate(sizes):
            packer.add(i, np.full(n, i, dtype="<u4").tobytes())
        packer.settle(True)
        assert sum(len(x[2]) // 4 for pieces in out for x in pieces) == sum(sizes)
        assert all(n == 16 or n & (n - 1) == 0 for n in (sum(len(x[2]) // 4 for x in pieces) for pieces in out))
        layouts.append(len(out))
    assert max(layouts) - min(layouts) <= 5
