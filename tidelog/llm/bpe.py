"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece's adjacent pairs are the leaves of a segment tree that holds minima of (rank, place). The root is the leftmost
pair of lowest rank; a merge changes three leaves, each in logarithmic time, until no pair can be merged.

Documents are cut before blanks that follow no other white space and each cut piece is remembered, in bounded caches, as
texts repeat most of their words. A cut there never lies inside a token: a token of the splitting pattern that holds a
blank after another character is white space throughout, and a run of white space is never cut.

Defined results: a null text counts as empty and has no ids; repeated rows and ties are encoded row by row; texts of any
length are encoded whole; an empty table gives no rows; other columns are kept, and a column named as an output is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import release_memory, ship

#: Fixed value: the public pattern that splits a text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank after other white space (all that re's \s takes), in Arrow's syntax.
BLANK_IN_RUN = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in prints:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items number at[0], at[1], ... of flat (which holds items of the given sizes) one after the other, and where each starts and the last ends."""
    start = np.concatenate([[0], np.cumsum(size)])
    number = size[at]
    ends = np.concatenate([[0], np.cumsum(number)])
    return flat[np.repeat(start[at] - ends[:-1], number) + np.arange(ends[-1])], ends


class PairTree:
    """Minima of (rank, place) over the adjacent pairs of one piece."""

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.node = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def put(self, place: int, value: int) -> None:
        node, i = self.node, self.size + place
        node[i] = value
        while i > 1:
            i >>= 1
            low, high = node[2 * i], node[2 * i + 1]
            best = low if low < high else high
            if node[i] == best:
                return
            node[i] = best


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library (JSON)."""

    def __init__(self, path: str, cached: int = 200_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], spec.get("added_tokens") or []
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.width = max([*vocab.values(), *(x["id"] for x in added)]) + 1
        self.token = [b""] * self.width
        for text, i in vocab.items():
            self.token[i] = bytes(back[c] for c in text)
        self.special = {x["content"]: x["id"] for x in added}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.of_byte = [vocab.get(c, -1) for c in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] * self.width + vocab[b], i)
            self.merged.append(vocab[a + b])
        order = sorted(self.rank)
        self.codes, self.code_rank = np.array(order or [-2], np.int64), np.array([self.rank[x] for x in order] or [0], np.int64)
        self.made = np.array(self.merged, np.int64)
        self.byte_ids, self.all_bytes = np.array(self.of_byte, np.int64), min(self.of_byte) >= 0
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.token_size = np.array([len(x) for x in self.token], np.int64)
        #: Cuts of letters and at most one mark, for which the pattern's answer is plain.
        self.plain = re.compile(r"( ?[A-Za-z]+)([.,;:!?]?)").fullmatch
        self.pieces = regex.compile(PIECES)
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cuts = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
        self.cached = cached
        self.of_piece: dict[str, bytes] = {}
        self.of_cut: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """ids of single bytes, merged until no pair has a rank."""
        n, width, rank, merged = len(ids), self.width, self.rank, self.merged
        if n < 2:
            return ids
        leaf = lambda i, j: rank[x] << 32 | i if (x := ids[i] * width + ids[j]) in rank else NONE
        tree = PairTree([leaf(i, i + 1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree.root()) != NONE:
            i = best & 0xFFFFFFFF
            j = after[i]
            k = after[i] = after[j]
            ids[i] = merged[best >> 32]
            if j < n - 1:
                tree.put(j, NONE)
            if k < n:
                before[k] = i
                tree.put(i, leaf(i, k))
            else:
                tree.put(i, NONE)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many short pieces at once, a segment tree for each in the rows of an array; ids as 32-bit integers."""
        n = np.array([len(x) for x in pieces])
        width = 1 << int(n.max() - 1).bit_length() if n.max() > 1 else 1
        end = width  # a place behind the last: writes to it are void
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < n[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(1, width + 2), n[:, None])
        after[after == n[:, None]] = end
        before = np.broadcast_to(np.arange(-1, width), ids.shape).copy()
        tree = np.full((len(pieces), 2 * width), NONE, np.int64)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank < NONE, rank << 32 | np.arange(width), NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            i = best & 0xFFFFFFFF
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = self.made[best >> 32]
            ids[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            h = before[live, i]
            for at, value in ((j, np.full(len(live), NONE)), (i, self._leaves(ids, live, i, k)), (h, self._leaves(ids, live, h, i))):
                ok = (at >= 0) & (at < width)
                self._put(tree, live[ok], width + at[ok], value[ok])
            live = live[tree[live, 1] < NONE]
        stay = ids >= 0
        raw, cut = ids[stay].astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(stay.sum(1))]) * 4
        return [raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = np.where((a < 0) | (b < 0), -1, a * self.width + b)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], NONE)

    def _leaves(self, ids: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = np.where(left < 0, NONE, self._ranks(ids[rows, np.maximum(left, 0)], ids[rows, right]))
        return np.where(rank < NONE, rank << 32 | np.maximum(left, 0), NONE)

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        tree[rows, node] = value
        while len(node) and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _learn_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, short ones together by length class."""
        found: dict[str, bytes] = {}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for x in pieces:
            raw = x.encode()
            if len(raw) > 64 or not self.all_bytes:
                found[x] = np.array(self.merge([i for b in raw if (i := self.of_byte[b]) >= 0]), "<i4").tobytes()
            else:
                by.setdefault((len(raw) - 1).bit_length(), []).append((x, raw))
        for group in by.values():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                found.update(zip([x for x, _ in part], self.merge_many([raw for _, raw in part]), strict=True))
        return found

    def _pieces(self, cut: str) -> list[str]:
        """The pieces of a cut; a special token is a piece of its own."""
        if m := self.plain(cut):
            return [x for x in m.groups() if x]
        if self.at_special is None or not self.at_special.search(cut):
            return self.pieces.findall(cut)
        return [y for i, x in enumerate(self.at_special.split(cut)) for y in ([x] if i % 2 else self.pieces.findall(x))]

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        """The ids of cuts that are new."""
        if len(self.of_piece) >= self.cached:
            self.of_piece.clear()
        if len(self.of_cut) >= self.cached:
            self.of_cut.clear()
        of, split = self.of_piece, [self._pieces(x) for x in cuts]
        new = self._learn_pieces([x for x in set().union(*split) if x not in of and x not in self.special])
        new |= {x: np.array([i], "<i4").tobytes() for x, i in self.special.items()}
        of.update((x, y) for x, y in new.items() if len(x) <= 64 and x not in self.special)
        get = lambda x: y if (y := new.get(x)) is not None else of[x]
        found = {cut: b"".join(map(get, parts)) for cut, parts in zip(cuts, split, strict=True)}
        self.of_cut.update((x, y) for x, y in found.items() if len(x) <= 64)
        return found

    def _known(self, cuts: list[str]) -> list[bytes]:
        """The ids of distinct cuts."""
        own = list(map(self.of_cut.get, cuts))
        if None in own:
            new = self._learn([x for x, y in zip(cuts, own, strict=True) if y is None])
            own = [new[x] if y is None else y for x, y in zip(cuts, own, strict=True)]
        return own

    def encode_many(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        runs = pc.match_substring_regex(texts, BLANK_IN_RUN)  # these texts are cut one by one
        split = pc.split_pattern(pc.if_else(runs, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        at, number = coded.indices.to_numpy().astype(np.int64), split.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(number)])
        # all but a text's first cut begin with a blank
        own = self._known([" " + x for x in coded.dictionary.to_pylist()])
        first = self._known(heads := list(dict.fromkeys(coded.dictionary.take(coded.indices.take(pa.array(ends[:-1]))).to_pylist())))
        place = {x: len(own) + i for i, x in enumerate(heads)}
        at[ends[:-1]] = [place[x] for x in coded.dictionary.take(coded.indices.take(pa.array(ends[:-1]))).to_pylist()]
        flat, size = np.frombuffer(b"".join([*own, *first]), "<i4"), np.array([len(x) for x in [*own, *first]], np.int64) // 4
        ids, offsets = gathered(flat, size, at)
        lists = pa.ListArray.from_arrays(pa.array(offsets[ends], pa.int32()), pa.array(ids))
        if not pc.any(runs).as_py():
            return lists
        cut = [self.cuts.findall(x) for x in texts.filter(runs).to_pylist()]
        of = dict(zip(every := list(set().union(*cut)), self._known(every), strict=True))
        odd = iter([np.frombuffer(b"".join([of[x] for x in own]), "<i4") for own in cut])
        parts = [next(odd) if r else ids[a:b] for r, a, b in zip(runs.to_pylist(), offsets[ends[:-1]].tolist(), offsets[ends[1:]].tolist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts)))

    def decode_many(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids; null is the empty text."""
        flat = ids.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())])
        raw, offsets = gathered(self.token_bytes, self.token_size, flat)
        cut = offsets[ends]
        out = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that end within a character
            whole = raw.tobytes()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
        return out.cast(pa.string())

    def encode(self, text: str) -> list[int]:
        return self.encode_many(pa.array([text], pa.string()))[0].as_py()

    def decode(self, ids) -> str:
        return self.decode_many(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


IDS, TEXT = T.ArrayType(T.IntegerType(), False), T.StringType()


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids: the token ids of the whole text."""
    at = docs.columns.index(text)
    return _mapped(docs, {ids: IDS}, lambda part: [loaded(path).encode_many(part.column(at))])


def decode_documents(docs: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with decoded: the text of the ids, special tokens included; null ids decode to the empty text."""
    at = docs.columns.index(ids)
    return _mapped(docs, {decoded: TEXT}, lambda part: [loaded(path).decode_many(part.column(at))])


def roundtrip_documents(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with ids, as encode_documents gives them, and what they decode to, in one pass and one worker a task."""
    at = docs.columns.index(text)

    def both(part: pa.RecordBatch) -> list[pa.Array]:
        own = loaded(path).encode_many(part.column(at))
        return [own, loaded(path).decode_many(own)]

    return _mapped(docs, {ids: IDS, decoded: TEXT}, both)


def _mapped(docs: DataFrame, new: dict[str, T.DataType], columns) -> DataFrame:
    ship(docs.sparkSession)
    keep = [i for i, c in enumerate(docs.columns) if c not in new]
    schema = T.StructType([docs.schema.fields[i] for i in keep] + [T.StructField(n, t, False) for n, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *columns(part)], names=schema.names)
        release_memory()

    return docs.mapInArrow(run, schema)


def ids_text(ids: str = "ids"):
    """Column: decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
