"""Brute-force versions that several tests share."""

import re
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, lowered, min_chars=40, min_docs=5):
    """(key, lines, lines dropped, text kept) of each row."""
    where = defaultdict(list)
    for n, (key, text) in enumerate(rows):
        for own in {lowered(x.strip(SPACE)) for x in (text or "").split("\n")}:
            if len(own) >= min_chars:
                where[own].append((n, key))
    keeper = {own: max((k for _, k in at if k is not None), default=None) for own, at in where.items() if len(at) >= min_docs}
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (own := lowered(x.strip(SPACE))) not in keeper or keeper[own] is None or key == keeper[own]]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def hits_by_hand(text, items, words, window=8):
    """(hit places, items) by all windows of all items."""
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            for at in range(len(own) - k + 1):
                if own[at : at + k] == w[j : j + k]:
                    hit.update(range(at, at + k))
                    found.add(str(item) if item is not None else "")
    return hit, found


def cut_by_hand(text, items, words, most=0.5):
    """The text without hit words and what lies between neighbours of them; None where too much is hit."""
    hit, _ = hits_by_hand(text, items, words)
    if not hit:
        return text
    if len(hit) > most * len(words(text)):
        return None
    place = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = "", 0
    for i, (a, b) in enumerate(place):
        if i in hit:
            if i - 1 not in hit:
                out += text[at:a] + " "
            at = b
    return out + text[at:]


def hand_fingerprint(text, lowered):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    own = [" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def hand_components(fps, ids):
    """For each row the smallest id in its class of links over at most three differing bits; None where no row has one."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]
