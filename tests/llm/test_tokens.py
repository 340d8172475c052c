"""op1 and op3 against the tokenizers library, and their data structures."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm.bpe import ByteBPE, PairTree, decode_documents, encode_documents, roundtrip_documents
from tidelog.llm.token_store import PerfectHash, Shard, ShardFile, WordEncoder, cuts_at_blanks, fingerprint, lookup, read_crc, read_store, with_crc, write_store

tokenizers = pytest.importorskip("tokenizers")


def library(path):
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def mixtures(n, seed):
    R = random.Random(seed)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "é", "É", "<|endoftext|>", "<|startoftext|>", "<|StartOfText|>", "'s", "'ll", "1", "Ⅷ", "́", "　", "\x1c", " ", "字", "😀", ".", "!!", "Hello", " world", "\r\n", "\x00", "K", "ﬁ", "Σ"]
    return ["".join(R.choice(parts) for _ in range(R.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_library(vocabulary, odd_texts):
    path = vocabulary("byte_bpe_50k.json")
    own, lib = ByteBPE(path, cached=50), library(path)
    texts = [x or "" for x in odd_texts] + mixtures(3000, 1)
    got = own.encode_many(pa.array(texts))
    for text, ids in zip(texts, got.to_pylist(), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    assert own.decode([171, 27]) == lib.decode([171, 27], skip_special_tokens=False)  # not a whole character
    assert own.encode_many(pa.array([None, "a"]))[0].as_py() == []


def test_bpe_runs_of_blanks_and_other_white_space(vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    own, lib = ByteBPE(path, cached=50), library(path)
    space = [c for c in map(chr, range(0x3001)) if c.isspace()]
    R = random.Random(7)
    parts = [" ", " ", "\xa0", "\xa0", "\n", "\t", "\u3000", "a", "b.", "\xe9", "<|endoftext|>", "'s", "1"]
    texts = ["a \xa0 \xa0 b", "a \xa0 \xa0 \xa0 \xa0 b", "\xa0 \xa0", " \xa0 ", *(f"a{c} b {c} {c}c" for c in space), *("".join(R.choice(parts) for _ in range(R.randint(0, 14))) for _ in range(3000))]
    for text, ids in zip(texts, own.encode_many(pa.array(texts)).to_pylist(), strict=True):
        assert ids == lib.encode(text, add_special_tokens=False).ids, text


def test_bpe_pieces_together_or_alone(vocabulary):
    own = ByteBPE(vocabulary("byte_bpe_50k.json"))
    R = random.Random(3)
    pieces = ["".join(R.choice("abcdeé ") for _ in range(R.randint(1, 40))).encode() for _ in range(300)]
    for piece, ids in zip(pieces, own.merge_many(pieces), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == own.merge([own.of_byte[b] for b in piece])


def test_pair_tree():
    R = random.Random(5)
    leaves = [R.randrange(1000) for _ in range(13)]
    tree = PairTree(list(leaves))
    for _ in range(200):
        assert tree.root() == min(leaves)
        i = R.randrange(13)
        leaves[i] = R.randrange(1000)
        tree.put(i, leaves[i])


def test_bpe_frames(spark, vocabulary, odd_texts):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(odd_texts)], "doc_id long, text string, decoded string")
    out = decode_documents(encode_documents(docs, path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == [x or "" for x in odd_texts]
    both = roundtrip_documents(docs, path).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in both] == [(r.ids, r.decoded) for r in out]
    assert encode_documents(docs.limit(0), path).count() == 0


def test_words_equal_library(vocabulary, odd_texts):
    path = vocabulary("word_bpe_49k.json")
    own, lib = WordEncoder(path, cached=50), library(path)
    texts = [x or "" for x in odd_texts] + mixtures(3000, 2)
    ids, number = own.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(number)[:-1]), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_words_with_capitals_before_marks(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    own, lib = WordEncoder(path, cached=50), library(path)
    marks = [chr(c) for c in [*range(0x300, 0x370), 0x5B0, 0x1AB0, 0x1DC0, 0x20D0, 0x2019, 0x3099, 0xFE20]]
    texts = [f"Plain {a}{m}{n} Words {a}X{m}" for a in "AHIJTWYZ" for m in marks for n in ("", "\u030c")]
    ids, number = own.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(number)[:-1]), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_words_that_differ_in_marks_are_learnt_once(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    own, lib = WordEncoder(path, cached=40), library(path)
    words = ["thonernt", "straße", "crème", "don", "x" * 70]
    texts = [f"{w}{m} {m}{w} {w}{m}{w}, {w.upper()}{m}" for w in words for m in ("", ".", ",", "...", "$$$", "?!)", "'s", "’", "1", "\u0301", "<|endoftext|>")]
    ids, number = own.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(number)[:-1]), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text
    own = WordEncoder(path, cached=40)
    own.encode(pa.array(["often, often. often"]))
    assert "often" in own.of and not {"often,", "often."} & own.of.keys()
    for i in range(20):  # a word that every batch holds outlives those that none asks for again
        own.encode(pa.array(["often " + " ".join("abcdefghij"[i // 10] + "abcdefghij"[i % 10] + c for c in "abcdefghij")]))
    held = own.of.keys() | own.old.keys()
    assert "often" in held and "aaa" not in held and len(held) <= 2 * (40 + 11)


def test_shards_are_read_and_summed_by_one_worker_a_task(spark, vocabulary):
    docs = spark.createDataFrame([(3, "three words here"), (1, None), (None, "no key"), (2, "one"), (2, "one")], "doc_id long, text string")
    manifest = write_store(docs, vocabulary("word_bpe_49k.json"))
    own = read_crc(manifest)
    assert str(own._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    want = with_crc(read_store(manifest))
    assert own.schema == want.schema and sorted(own.collect(), key=str) == sorted(want.collect(), key=str) and own.count() == 5


def test_perfect_hash():
    R = random.Random(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.array(R.sample(range(-(1 << 40), 1 << 40), n), np.int64)
        made = PerfectHash.build(keys)
        assert sorted(made.number(keys).tolist()) == list(range(n))
        assert len(set(fingerprint(keys.astype(np.uint64)).tolist())) >= n - 2


def test_store_roundtrip(spark, vocabulary, odd_texts, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    lib = library(path)
    rows = [(3 * i - 20, x) for i, x in enumerate(odd_texts)] + [(7, "again"), (7, "again"), (None, "no key"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(5)
    manifest = write_store(docs, path, end_id=1)
    got = read_store(manifest).collect()
    assert len(got) == len(rows)
    want = sorted((k is not None, k or 0, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for k, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    # starts are those of the rows in ascending order of keys
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    for r in with_crc(read_store(manifest)).collect():
        own = next(x for x in got if x.start == r.start)
        assert (r.n_tokens, r.ids_crc32) == (len(own.ids), zlib.crc32(np.array(own.ids, "<u4").tobytes()))
    found = lookup(manifest, [7, -20, 1_000_001]).collect()
    assert sorted(r.doc_id for r in found) == sorted(k for k, _ in rows if k in (7, -20))
    assert read_store(write_store(docs.limit(0), path)).count() == 0


def test_many_shards(spark, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
        manifest = write_store(docs, path)
        assert manifest.count() > 4
        assert sorted(r.doc_id for r in lookup(manifest, list(range(0, 500, 7))).collect()) == list(range(0, 500, 7))
        starts = [r.start for r in read_store(manifest).orderBy("doc_id").collect()]
        assert starts == sorted(starts) and starts[0] == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_access_by_key_reads_a_few_blocks(tmp_path):
    """However many keys a shard has, a key costs its blocks of slots, a few words and its ids."""
    R, most = np.random.default_rng(5), []
    for n in (1_000, 100_000):
        uri = str(tmp_path / f"{n}.tokens")
        keys, file = np.unique(R.integers(-(1 << 62), 1 << 62, n)), ShardFile(uri, 0, 2)
        file.add(pa.array(keys), np.repeat(np.arange(len(keys)) % 60_000, 3).astype("<u2"), np.full(len(keys), 3))
        one = file.close()
        assert one["n_ids"] == 3 * len(keys) and one["first_key"] == keys[0]
        shard, whole = Shard(uri), Shard(uri).load()
        some = np.concatenate([keys[:: max(1, n // 50)], R.integers(-(1 << 62), 1 << 62, 50)])
        for a, b in zip(shard.places(some), whole.places(some), strict=True):
            assert (a == b).all()
        read = []

        class Counted:
            def __init__(self, of):
                self.of = of

            def read_at(self, length, at):
                read.append(length)
                return self.of.read_at(length, at)

        shard.file = Counted(shard.file)
        for k in (3, 500, 999):
            row, rows = shard.places(keys[k : k + 1])
            first, ids = shard.ids(int(row[0]), int(rows[0]))
            assert (row[0], rows[0], first[0]) == (k, 1, 3 * k) and ids[0].tolist() == [k] * 3
        most.append(sum(read))
    assert most[1] < 3 * 1000 and most[1] < 3 * most[0]


def test_shards_are_cut_by_bytes(spark, vocabulary):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    path = vocabulary("word_bpe_49k.json")
    manifest = write_store(docs.repartition(2), path, file_bytes=2_000)
    one = write_store(docs.coalesce(1), path)
    assert manifest.count() >= one.count()
    assert sorted(map(tuple, read_store(manifest).collect()), key=str) == sorted(map(tuple, read_store(one).collect()), key=str)
    assert sorted(r.doc_id for r in lookup(manifest, [0, 7, 299, 300]).collect()) == [0, 7, 299]


def test_other_vocabularies_get_whole_texts(vocabulary, odd_texts):
    assert cuts_at_blanks(vocabulary("word_bpe_49k.json")) and not cuts_at_blanks(vocabulary("byte_bpe_50k.json"))
    path = vocabulary("byte_bpe_50k.json")
    ids, number = WordEncoder(path).encode(pa.array(odd_texts, pa.string()))
    lib = library(path)
    want = [lib.encode(x or "", add_special_tokens=False).ids for x in odd_texts]
    assert number.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
