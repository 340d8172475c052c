"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of the normalised test items. A document's words are streamed through it while
the length of the longest match that ends at each word is tracked: at length `window` or more, the last `window` words
are a window of some item. Items of fewer words count as a whole. Each state knows its items.

A worker holds one automaton of at most `most_words` item words (a longer list of items is cut into parts, with one pass
over the documents for each; a longer item into pieces that overlap). Before the automaton, runs of words
whose neighbouring pairs all stand in the items are found by array look-ups; no match of two words or more leaves them.

Defined results: A-Z are lowered; words are runs of digits, letters a-z and anything beyond ASCII. Null and empty texts
have no words; an item without words has no windows; rows with one item_id are one item; a null item_id is the id "". No
items: nothing is hit. Repeated documents each get their own result. Other columns stay; names that begin with _ are ours.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import filled, release_memory, ship, stored

#: Each byte of a text: A-Z lowered, word bytes as they are, all others a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; add them all, then seal()."""

    def __init__(self, window: int = 8):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        self.sequences: list[tuple[str, list[int]]] = []

    def add(self, item: str, sequence: list[bytes]) -> None:
        number = self.number
        ids = [number.setdefault(w, len(number)) for w in sequence]
        if ids:
            self.sequences.append((item, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that are no longer than those of p and c."""
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def seal(self) -> SuffixAutomaton:
        """Gives the states their items, and the pairs of neighbouring words."""
        n, window, link, length = len(self.next), self.window, self.link, self.length
        items: list[set[str]] = [set() for _ in range(n)]
        whole: dict[int, dict[int, set[str]]] = {}
        pairs = set()
        for item, ids in self.sequences:
            pairs.update(zip(ids, ids[1:], strict=False))
            state = 0
            for c in ids:
                state = self.next[state][c]
                up = state
                while up > 0 and item not in items[up]:
                    items[up].add(item)
                    up = link[up]
            if len(ids) < window:
                while length[link[state]] >= len(ids):
                    state = link[state]
                whole.setdefault(state, {}).setdefault(len(ids), set()).add(item)
        self.of_window: list[int] = [0] * n  # the state of the last `window` words
        self.of_whole: list[int] = [0] * n  # the nearest state, upwards, that is a short item
        for state in sorted(range(1, n), key=length.__getitem__):
            self.of_window[state] = 0 if length[state] < window else self.of_window[link[state]] or state
            self.of_whole[state] = state if state in whole else self.of_whole[link[state]]
        self.items, self.whole = items, whole
        self.shortest = min([window, *(k for x in whole.values() for k in x)])
        self.pairs = np.array(sorted(a * len(self.number) + b for a, b in pairs) or [-1], np.int64)
        return self

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, disjoint and in order; items with windows that occur)."""
        known = np.array(list(map(self.number.get, sequence, _never)), np.int64) if len(sequence) < len(_never) else np.array([self.number.get(w, -1) for w in sequence], np.int64)
        if self.shortest < 2:
            inside = known >= 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
            runs = zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
        else:
            a, b = known[:-1], known[1:]
            code = np.where((a < 0) | (b < 0), -2, a * len(self.number) + b)
            near = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
            edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
            runs = ((x, y + 1) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y + 1 - x >= self.shortest)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in runs:
            self._stream(known[start:end].tolist(), start, spans, items)
        return spans, items

    def _stream(self, ids: list[int], start: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for at, c in enumerate(ids, start + 1):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            hit = 0
            if size >= window:
                hit = window
                items |= self.items[self.of_window[state]]
            up = self.of_whole[state]
            while up:
                for k, own in self.whole[up].items():
                    if k <= size:
                        hit = max(hit, k)
                        items |= own
                up = self.of_whole[link[up]]
            if hit:
                a = at - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, at))


_never = [-1] * 1_000_000
_built: dict[str, SuffixAutomaton] = {}


def _automaton(digest: str, raw: bytes) -> SuffixAutomaton:
    """One automaton for each worker process."""
    if digest not in _built:
        _built.clear()
        window, sequences = pickle.loads(raw)
        made = SuffixAutomaton(window)
        for item, sequence in sequences:
            made.add(item, sequence)
        _built[digest] = made.seal()
    return _built[digest]


def item_parts(items: DataFrame, *, item: str = "item_id", text: str = "text", window: int = 8, most_words: int = 250_000) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in parts of at most most_words each, streamed through the driver one part at a time."""
    part, held = [], 0
    step = max(window, most_words) - window + 1
    for row in items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), filled(text)).toLocalIterator():
        own = words(row[1])
        pieces = [own[at : at + max(window, most_words)] for at in range(0, max(1, len(own) - window + 1), step)]
        for piece in pieces:
            if part and held + len(piece) > most_words:
                yield part
                part, held = [], 0
            if piece:
                part.append((row[0], piece))
                held += len(piece)
    yield part


def _scanned(docs: DataFrame, part: list, window: int, text: str):
    """A function of a task's batches: slices of rows, each with the numbers of words of its texts and what a scan finds in them."""
    import hashlib

    ship(docs.sparkSession)
    raw = pickle.dumps((window, part))
    digest, held = hashlib.sha256(raw).hexdigest(), docs.sparkSession.sparkContext.broadcast(raw)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple[list[tuple[int, int]], set[str]]]]]:
        made = None
        for batch in batches:
            made = made or _automaton(digest, held.value)
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                split = [words(x) for x in rows.column(at).to_pylist()]
                yield rows, [len(x) for x in split], [made.scan(x) for x in split]
        release_memory()

    return scan


def _matched(docs: DataFrame, part: list, window: int, text: str) -> DataFrame:
    scan = _scanned(docs, part, window, text)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("_n_words long, _spans array<struct<a: int, b: int>>, _items array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n_words, found in scan(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array(n_words, pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in spans] for spans, _ in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array([sorted(own) for _, own in found], pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, most_words: int = 250_000) -> DataFrame:
    """docs with _n_words, _spans (of hit words: [a, b), disjoint, in order) and _items (ids of the items found)."""
    parts = item_parts(items, item=item, text=item_text, window=window, most_words=most_words)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _matched(docs, first, window, text)
    keyed, met = _met(docs, _chain(first, second, parts), window, text)
    counted = _matched(keyed, [], window, text).drop("_spans", "_items")
    return _joined(counted, met, [*docs.columns, "_n_words"])


def _met(docs: DataFrame, parts: Iterator[list], window: int, text: str) -> tuple[DataFrame, DataFrame]:
    """docs with two hashes of the text, (_row1, _row2); by these, the _spans and _items of all parts. One pass for each part; what they find meets by document."""
    keyed = docs.withColumn("_row1", F.xxhash64(filled(text))).withColumn("_row2", F.xxhash64(F.concat(F.lit("row:"), filled(text))))
    narrow = keyed.select("_row1", "_row2", F.col(text).alias("_text"))
    passes = []
    for part in parts:
        passes.append(stored(_matched(narrow, part, window, "_text").where(F.size("_items") > 0).select("_row1", "_row2", "_spans", "_items").dropDuplicates(["_row1", "_row2"]), "leaks"))
    met = reduce(DataFrame.unionByName, passes).groupBy("_row1", "_row2").agg(F.array_sort(F.flatten(F.collect_list("_spans"))).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    # overlapping spans of several passes become one
    joined = F.aggregate(
        "_all",
        F.array().cast("array<struct<a: int, b: int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return keyed, met.select("_row1", "_row2", joined.alias("_spans"), "_items")


def _joined(keyed: DataFrame, met: DataFrame, names: list[str]) -> DataFrame:
    none = F.array().cast("array<struct<a: int, b: int>>")
    return keyed.join(met, ["_row1", "_row2"], "left").select(*names, F.coalesce("_spans", none).alias("_spans"), F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def cut_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, most_words: int = 250_000, min_items: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """docs without the hit spans of documents in which at least min_items items occur; without those documents of whose words more than the share max_coverage is hit.

    A span goes from its first word's first byte to its last word's last; a blank takes its place. Texts without hits stay as they are.
    One Python worker a task finds and cuts: workers live on, and the next operator's memory would be held by each.
    """
    at, names = docs.columns.index(text), docs.columns
    parts = item_parts(items, item=item, text=item_text, window=window, most_words=most_words)
    first = next(parts)
    second = next(parts, None)

    def cut(rows: pa.RecordBatch, n_words: list[int], found: list) -> pa.RecordBatch:
        """The rows that stay, with their texts as cut."""
        stay, out = [], []
        for x, n, (spans, own) in zip(rows.column(at).to_pylist(), n_words, found, strict=True):
            stay.append(len(own) < min_items or sum(b - a for a, b in spans) <= max_coverage * n)
            out.append(without(x, spans) if stay[-1] and spans and len(own) >= min_items else x)
        done = pa.RecordBatch.from_arrays([*rows.columns[:at], pa.array(out, rows.column(at).type), *rows.columns[at + 1 : len(names)]], names=names)
        return done if all(stay) else done.filter(pa.array(stay, pa.bool_()))

    if second is None:
        scan = _scanned(docs, first, window, text)
        return docs.mapInArrow(lambda batches: (cut(*x) for x in scan(batches)), docs.schema)
    keyed, met = _met(docs, _chain(first, second, parts), window, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                spans, own = ([[(s["a"], s["b"]) for s in x] for x in rows.column(len(names)).to_pylist()], rows.column(len(names) + 1).to_pylist())
                n_words = [len(words(x)) if hit else 0 for x, hit in zip(rows.column(at).to_pylist(), spans, strict=True)]
                yield cut(rows, n_words, list(zip(spans, own, strict=True)))
        release_memory()

    return _joined(keyed, met, names).mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words."""
    raw = text.encode()
    place = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : place[a][0]])
        at = place[b - 1][1]
    return b" ".join([*out, raw[at:]]).decode()
