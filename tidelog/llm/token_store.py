"""Token ids as raw binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their key, encoded, and written in key order: each task writes one shard file with the
raw ids and, behind them, the index; at file_bytes of ids a task goes on to the next file. The index is a minimal perfect hash over the shard's keys in levels: a key takes
the first level at which it is alone in its slot, and its number is the rank of that slot among the taken ones, of which every 512th is kept. By that
number the shard keeps the key's fingerprint and its place, so an access by key reads one block of slots a level, a few words and the ids themselves, however large the shard is.

A shard file: ids (unsigned little-endian, 16 bits where the vocabulary allows it, else 32), index sections, a JSON
directory of the sections, its length (8 bytes) and the mark. A manifest table lists the shards that committed tasks
wrote; files of failed attempts are in no manifest and count for nothing.

Defined results: a null text counts as empty and holds the end id only; keys are integers; a null key is a key of its
own below all others; rows of one key stand side by side, ordered by a hash of their text, and an access by key gives
them all; if they are many they may reach over several shards, all of which are visited. Texts of any length are encoded whole. An empty table has an empty
manifest. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import byte_symbols, gathered
from tidelog.llm.common import filled, open_fs, release_memory, scratch, ship, stored

MARK = b"TLSHARD2"
BLOCK = 512
MANIFEST = "shard long, path string, n_rows long, n_ids long, first_key long, last_key long, null_keys long"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mixing of unsigned 64-bit keys, another for each seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Levels of taken slots; number(key) is in 0..n-1, another for each of the n keys it was built from."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.taken = np.unpackbits(bits, count=sum(sizes)).astype(bool) if sizes else np.zeros(0, bool)
        self.rank = np.concatenate([[0], np.cumsum(self.taken, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.uint64)
        while len(left):
            size = max(1, int(gamma * len(left)))
            slot = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(sizes, np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for a key that no level takes. A key that was not built in may get any number."""
        keys = keys.astype(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            slot = base + (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.taken[slot]
            out[open_[hit]] = self.rank[slot[hit]]
            open_, base = open_[~hit], base + size
            if not len(open_):
                break
        return out


class Shard:
    """One shard file, open for access by key. Its sections are read by position; load() takes the index into memory, for access to all of its keys."""

    def __init__(self, uri: str):
        store, path = open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"{uri} is no shard file")
        length = int.from_bytes(tail[:8], "little")
        self.about = json.loads(self.file.read_at(length, size - 16 - length))
        self.width, self.null_rows, self.sizes = self.about["width"], self.about["null_rows"], self.about["sizes"]
        self.loaded: dict[str, np.ndarray] = {}
        self.hash: PerfectHash | None = None

    def load(self) -> Shard:
        self.loaded = {name: self.get(name) for name in ("keys", "starts", "prints", "row", "rows")}
        self.hash = PerfectHash(self.sizes, self.get("bits"))
        return self

    def get(self, name: str, at: int = 0, n: int | None = None) -> np.ndarray:
        """n values of a section from number `at` on; all of them by default."""
        if name in self.loaded:
            return self.loaded[name][at : None if n is None else at + n]
        place, length, kind = self.about[name]
        width = np.dtype(kind).itemsize
        length = length - at * width if n is None else min(n * width, length - at * width)
        return np.frombuffer(self.file.read_at(length, place + at * width), kind)

    def _number(self, key: int) -> int:
        """The number of one key, by a block of slots for each level that it was not alone at; -1 if no level takes it."""
        one, base = np.array([key], np.int64).astype(np.uint64), 0
        for level, size in enumerate(self.sizes):
            slot = base + int(mixed(one, level)[0] % np.uint64(size))
            block = np.unpackbits(self.get("bits", slot // BLOCK * (BLOCK // 8), BLOCK // 8))
            if block[slot % BLOCK]:
                return int(self.get("ranks", slot // BLOCK, 1)[0]) + int(block[: slot % BLOCK].sum())
            base += size
        return -1

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; no rows where the fingerprint tells that the key is not there."""
        at = self.hash.number(keys) if self.hash else np.array([self._number(int(k)) for k in keys], np.int64)
        prints, row, rows = fingerprint(keys.astype(np.uint64)), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if self.hash:
            here = np.flatnonzero(at >= 0)
            here = here[self.loaded["prints"][at[here]] == prints[here]]
            row[here], rows[here] = self.loaded["row"][at[here]], self.loaded["rows"][at[here]]
            return row, rows
        for i in np.flatnonzero(at >= 0):
            if self.get("prints", at[i], 1)[0] == prints[i]:
                row[i], rows[i] = self.get("row", at[i], 1)[0], self.get("rows", at[i], 1)[0]
        return row, rows

    def ids(self, row: int, rows: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
        """(first places, ids) of neighbouring rows, by one read."""
        ends = self.get("starts", row, rows + 1).astype(np.int64)
        raw = np.frombuffer(self.file.read_at(int(ends[-1] - ends[0]) * self.width, int(ends[0]) * self.width), f"<u{self.width}")
        return ends[:-1], np.split(raw, ends[1:-1] - ends[0])

    def close(self) -> None:
        self.file.close()


class ShardFile:
    """A shard file while it is written."""

    def __init__(self, uri: str, shard: int, width: int):
        store, to = open_fs(uri)
        store.create_dir(to.rpartition("/")[0], recursive=True)
        self.uri, self.shard, self.width, self.out = uri, shard, width, store.open_output_stream(to)
        self.keys, self.lengths, self.n_null, self.bytes = [], [], 0, 0

    def add(self, keys: pa.Array, ids: np.ndarray, number: np.ndarray) -> None:
        """Rows in ascending key order, null first: their keys, all their ids, and the number of ids of each."""
        self.out.write(raw := ids.tobytes())
        self.bytes += len(raw)
        self.lengths.append(number)
        self.n_null += keys.null_count
        self.keys.append(keys.drop_null().to_numpy())

    def close(self) -> dict:
        """Writes the index; the shard's row in the manifest."""
        keys, lengths = np.concatenate(self.keys), np.concatenate(self.lengths)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        own, first, count = np.unique(keys, return_index=True, return_counts=True)
        made = PerfectHash.build(own)
        at = made.number(own)
        prints, row, number = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
        prints[at], row[at], number[at] = fingerprint(own), first + self.n_null, count
        place, about = self.bytes, {"width": self.width, "null_rows": self.n_null, "sizes": made.sizes}
        for name, data in (("keys", own.astype("<i8")), ("starts", starts), ("prints", prints), ("row", row), ("rows", number), ("bits", made.bits), ("ranks", made.rank[::BLOCK].astype("<u4"))):
            self.out.write(raw := data.tobytes())
            about[name] = [place, len(raw), data.dtype.str]
            place += len(raw)
        self.out.write(listed := json.dumps(about).encode())
        self.out.write(len(listed).to_bytes(8, "little") + MARK)
        self.out.close()
        first_key, last_key = (int(own[0]), int(own[-1])) if len(own) else (None, None)
        return {"shard": self.shard, "path": self.uri, "n_rows": len(lengths), "n_ids": int(starts[-1]), "first_key": first_key, "last_key": last_key, "null_keys": self.n_null}


#: The normaliser and the pre-tokeniser that the cuts of WordEncoder rest on.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_at_blanks(path: str) -> bool:
    """Whether a vocabulary file normalises and splits as WordEncoder's cuts take for granted, and all its added tokens are special ones between <| and |>."""
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    added = all(x["content"].startswith("<|") and x["content"].endswith("|>") and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in about.get("added_tokens") or [])
    return added and about.get("normalizer") == NORMALISER and about.get("pre_tokenizer") == SPLITTER and (about.get("model") or {}).get("type") == "BPE"


class WordEncoder:
    """The tokenizers library over whole texts, with words and runs remembered in a bounded cache.

    The vocabulary's pattern drops white space and lets no token reach over it, so a text's ids are those of its words
    between ASCII white space, one after the other. A-Z may be lowered first, as the vocabulary's normaliser lowers them,
    but not where a special token could come about, nor before a combining mark, as the normaliser composes the two before
    it lowers and some pairs compose in lower case only. A word of plain letters and marks (which the normaliser leaves as they
    are but for case) goes to the library's model in runs of either, as the vocabulary's pattern cuts it. Letters with marks behind them, as
    most words are, are cut in Arrow, so words that differ in their marks only are looked up once. Any other word
    goes through the library's whole pipeline. All this holds for vocabularies that cuts_at_blanks() knows; with any other the library gets whole texts.

    The cache has a newer and an older part of `cached` entries each, and what a batch adds. When the newer is full it becomes the older; what is asked for again comes back as new.
    """

    LETTERS, MARKS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", ".,;:!?()&%$#*\"/+=_-"
    PLAIN = re.compile(r"[a-zß-öø-ÿÀ-ÖØ-Þ.,;:!?()&%$#*\"/+=_-]+")
    #: A capital before what may be a combining mark, in Arrow's syntax: all marks are from U+0300 on, none in U+2000-206F.
    MARKED = r"[A-Z][^\x00-\x{2ff}\x{2000}-\x{206f}]"
    RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")

    def __init__(self, path: str, cached: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.symbols = byte_symbols()
        self.cached, self.of, self.old = cached, {}, {}
        self.cuts = cuts_at_blanks(path)

    def _run(self, run: str) -> bytes:
        found = self.of.get(run)
        if found is None:
            found = self.old.get(run)
            if found is None:
                own = run if run.isascii() else "".join([self.symbols[b] for b in run.encode()])
                found = array(self.kind, [x.id for x in self.tokenizer.model.tokenize(own)]).tobytes()
            if len(run) <= 64:
                self.of[run] = found
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that are not in the cache's newer part."""
        found, other, old, plain, runs, run = {}, [], self.old.get, self.PLAIN.fullmatch, self.RUNS.findall, self._run
        for w in words:
            if (x := old(w)) is not None:
                found[w] = x
            elif plain(w):
                found[w] = b"".join(map(run, runs(w.lower())))
            else:
                other.append(w)
        for w, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            found[w] = array(self.kind, x.ids).tobytes()
        self.of.update((w, x) for w, x in found.items() if len(w) <= 64)
        if len(self.of) >= self.cached:
            self.of, self.old = {}, self.of
        return found

    def _known(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words."""
        words = words.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.of.get, words))
        if None in own:
            new = self._learn([w for w, x in zip(words, own, strict=True) if x is None])
            own = [new[w] if x is None else x for w, x in zip(words, own, strict=True)]
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts:
            found = [np.array(x.ids, f"<u{self.width}") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, f"<u{self.width}"), *found]), np.array([len(x) for x in found], np.int64)
        as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, self.MARKED))
        split = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        head, tail = pc.utf8_rtrim(words, self.MARKS), pc.utf8_ltrim(words, self.LETTERS)
        # letters and then marks, where the two make up the word: ids of either; else the word's as a whole
        cut = pc.equal(pc.add(pc.binary_length(head), pc.binary_length(tail)), pc.binary_length(words))
        heads, tails = pc.if_else(cut, head, words).dictionary_encode(), pc.if_else(cut, tail, "").dictionary_encode()
        of_head, of_tail = self._known(heads.dictionary), self._known(tails.dictionary)
        flat = np.frombuffer(b"".join([*of_head, *of_tail]), f"<u{self.width}")
        size = np.array([len(x) for x in [*of_head, *of_tail]], np.int64) // self.width
        both = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(of_head)], 1)
        ids, ends = gathered(flat, size, both[at].ravel())
        return ids, np.diff(ends[2 * np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_store(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, path: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Encodes the texts, writes shards in ascending key order under path (the shared folder's, if not given), returns the manifest."""
    spark = docs.sparkSession
    ship(spark)
    home = path or scratch(spark, "tokens")
    order = [F.col("_key").asc_nulls_first(), F.col("_hash")]
    rows = docs.select(F.col(key).cast("long").alias("_key"), filled(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash")

    names = pa.schema([("shard", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_rows", "n_ids", "first_key", "last_key", "null_keys"))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(vocabulary), TaskContext.get()
        file, n = None, 0
        for batch in batches:
            # some 8 MB of text at once, 2048 rows at most: words that repeat are looked up once
            step = max(1, min(2048, batch.num_rows * (8 << 20) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if file is None:
                    file, n = ShardFile(f"{home}/shard-{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.tokens", (task.partitionId() << 32) + n, encoder.width), n + 1
                ids, number = encoder.encode(part.column(1))
                file.add(part.column(0), np.insert(ids, np.cumsum(number), end_id), number + 1)
                if file.bytes >= file_bytes:
                    yield pa.RecordBatch.from_pylist([file.close()], names)
                    file = None
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], names)
        release_memory()

    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def _each_shard(manifest: DataFrame) -> DataFrame:
    """The shards, one row each, with the ids before each, dealt to the tasks."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for one in (x for b in batches for x in b.select(["path", "start"]).to_pylist()):
        shard = Shard(one["path"]).load()
        if shard.null_rows:
            yield from _rows(shard, one["start"], [None], np.array([0]), np.array([shard.null_rows]))
        for at in range(0, len(shard.loaded["keys"]), 512):
            keys = shard.get("keys", at, 512)
            row, rows = shard.places(keys)
            if not rows.all():
                raise ValueError(f"{one['path']}: a key is not in its own index")
            yield from _rows(shard, one["start"], keys, row, rows)
        shard.close()


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every row, each fetched from its shard by key through the index."""
    return _each_shard(manifest).mapInArrow(_read, "doc_id long, start long, ids array<int>")


def read_crc(manifest: DataFrame) -> DataFrame:
    """with_crc(read_store(manifest)) by one Python worker a task: workers live on, and each would hold what it once encoded with."""
    return _each_shard(manifest).mapInArrow(lambda batches: _crc(_read(batches)), CRC)


def _rows(shard: Shard, start: int, keys, row: np.ndarray, rows: np.ndarray, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches of the keys' rows, of at most `most` rows each."""
    each = np.repeat(np.arange(len(rows)), rows)
    places = np.concatenate([np.arange(a, a + n) for a, n in zip(row.tolist(), rows.tolist(), strict=True)]) if len(rows) else np.zeros(0, np.int64)
    for at in range(0, len(places), most):
        here, of = places[at : at + most], each[at : at + most]
        if len(here) and here[-1] - here[0] + 1 == len(here) and (np.diff(here) == 1).all():
            first, ids = shard.ids(int(here[0]), len(here))
        else:
            each_one = [shard.ids(int(x)) for x in here]
            first, ids = np.array([a[0] for a, _ in each_one]), [x for _, own in each_one for x in own]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if keys[i] is None else int(keys[i]) for i in of], pa.int64()),
                pa.array(start + first, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
            ],
            names=["doc_id", "start", "ids"],
        )


def lookup(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, start, ids) of the given keys; keys that are nowhere give no row."""
    wanted = np.unique(np.array([k for k in keys if k is not None], np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (x for b in batches for x in b.to_pylist()):
            if one["first_key"] is None:
                continue
            here = wanted[(wanted >= one["first_key"]) & (wanted <= one["last_key"])]
            if len(here):
                shard = Shard(one["path"])
                if 64 * len(here) > one["n_rows"]:  # many of the shard's keys: the whole index is less than their blocks
                    shard.load()
                row, rows = shard.places(here)
                yield from _rows(shard, one["start"], here, row, rows)
                shard.close()

    return _each_shard(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


CRC = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        view = memoryview(flat.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def with_crc(rows: DataFrame) -> DataFrame:
    """rows with n_tokens and ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    return rows.mapInArrow(_crc, CRC)
