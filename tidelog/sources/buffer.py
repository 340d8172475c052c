"""The rows that wait to be flushed, with the newest version of each key at hand."""

from __future__ import annotations

ROW_BYTES = 17  # what a buffered row counts for beside its value

Version = tuple[int, int, dict]  # seq, op, row


class Buffer:
    def __init__(self, key: list[str], rows: list[Version] = ()):
        self.key, self.rows, self.newest, self.bytes = key, [], {}, 0
        for x in rows:
            self.add(x)

    def __len__(self) -> int:
        return len(self.rows)

    def _at(self, row: dict) -> tuple:
        return tuple(bytes(v) if isinstance(v, bytearray) else v for v in (row[k] for k in self.key))

    def get(self, row: dict) -> Version | None:
        """The newest version of a row's key."""
        return self.newest.get(self._at(row))

    def add(self, x: Version) -> None:
        self.rows.append(x)
        self.bytes += ROW_BYTES + sum(len(v) if isinstance(v, (bytes, bytearray, str)) else 8 for v in x[2].values() if v is not None)
        at = self._at(x[2])
        if at not in self.newest or x[0] > self.newest[at][0]:
            self.newest[at] = x
