"""Table schemas: tag columns, a time index, field columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

SEQ, OP = "__seq", "__op_type"
PUT, DELETE = 0, 1


class Role(str, Enum):
    TAG = "tag"
    TIME = "time"
    FIELD = "field"


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: T.DataType
    role: Role


@dataclass(frozen=True)
class TableSchema:
    """Columns in order. Tags and time index together are the key of a row; there they are never null."""

    columns: tuple[ColumnDef, ...]

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len({n.lower() for n in names}) != len(names):
            raise ValueError("column names must be unique, whatever their case")
        if any(n.startswith("__") for n in names):
            raise ValueError("names that begin with __ are reserved")
        if not self.tags:
            raise ValueError("at least one tag column is needed")
        times = [c for c in self.columns if c.role is Role.TIME]
        if len(times) != 1:
            raise ValueError("exactly one time index is needed")
        if not isinstance(times[0].kind, (T.LongType, T.TimestampNTZType, T.TimestampType)):
            raise ValueError("the time index must be a long or a timestamp")
        for c in self.columns:
            if c.role is Role.TAG and isinstance(c.kind, (T.FloatType, T.DoubleType, T.MapType)):
                raise ValueError(f"{c.name}: {c.kind.simpleString()} can't be a tag")

    @classmethod
    def of(cls, tags: dict[str, T.DataType], time: tuple[str, T.DataType], fields: dict[str, T.DataType] | None = None) -> TableSchema:
        return cls((*(ColumnDef(n, k, Role.TAG) for n, k in tags.items()), ColumnDef(*time, Role.TIME), *(ColumnDef(n, k, Role.FIELD) for n, k in (fields or {}).items())))

    @classmethod
    def default(cls) -> TableSchema:
        """tags BINARY, timestamp BIGINT, fields BINARY."""
        return cls.of({"tags": T.BinaryType()}, ("timestamp", T.LongType()), {"fields": T.BinaryType()})

    def _names(self, role: Role) -> list[str]:
        return [c.name for c in self.columns if c.role is role]

    @property
    def tags(self) -> list[str]:
        return self._names(Role.TAG)

    @property
    def time(self) -> str:
        return self._names(Role.TIME)[0]

    @property
    def fields(self) -> list[str]:
        return self._names(Role.FIELD)

    @property
    def key(self) -> list[str]:
        return [*self.tags, self.time]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def struct(self) -> T.StructType:
        """What a query sees."""
        return T.StructType([T.StructField(c.name, c.kind, c.role is Role.FIELD, {"semantic": c.role.value}) for c in self.columns])

    @property
    def log_struct(self) -> T.StructType:
        """What the change log holds."""
        return T.StructType([*(T.StructField(c.name, c.kind, c.role is Role.FIELD) for c in self.columns), T.StructField(SEQ, T.LongType(), False), T.StructField(OP, T.ByteType(), False)])

    def key_of(self, *values, **named) -> dict:
        """A key as a dict, from the tags' values and the time in order or by name."""
        out = dict(zip(self.key, values, strict=False)) | named
        if set(out) != set(self.key) or any(v is None for v in out.values()):
            raise ValueError(f"a key has {self.key}, none of them null")
        return out

    def value_of(self, *values, **named) -> dict:
        """Fields as a dict; those that are not given are null."""
        out = dict(zip(self.fields, values, strict=False)) | named
        if unknown := set(out) - set(self.fields):
            raise ValueError(f"no such fields: {sorted(unknown)}")
        return {f: out.get(f) for f in self.fields}

    def to_json(self) -> list[dict]:
        return [{"name": c.name, "type": c.kind.json(), "role": c.role.value} for c in self.columns]

    @classmethod
    def from_json(cls, rows: list[dict]) -> TableSchema:
        import json

        return cls(tuple(ColumnDef(r["name"], T._parse_datatype_json_value(json.loads(r["type"])), Role(r["role"])) for r in rows))
