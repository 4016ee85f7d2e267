"""Record ids: `table:key`, where a key is a text or an integer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DIGITS = re.compile(r"-?\d+")


class IdError(ValueError):
    """A text that is no record id."""


@dataclass(frozen=True)
class RecordId:
    table: str
    key: str | int

    def __post_init__(self) -> None:
        if not _BARE.fullmatch(self.table):
            raise IdError(f"not a table name: {self.table!r}")
        if self.key == "":
            raise IdError("empty key")

    @classmethod
    def parse(cls, text: str) -> RecordId:
        """`t:key`; digits become an integer, but keys in <> or ⟨⟩ are text without their brackets. A text of digits prints as the integer does, so it is read back as one."""
        table, colon, key = text.partition(":")
        if not colon:
            raise IdError(f"not a record id: {text!r}")
        if len(key) > 1 and (key[0], key[-1]) in (("<", ">"), ("⟨", "⟩")):
            return cls(table, key[1:-1])
        return cls(table, int(key) if _DIGITS.fullmatch(key) else key)

    def __str__(self) -> str:
        key = str(self.key)
        return f"{self.table}:{key if isinstance(self.key, int) or _BARE.fullmatch(key) or key.isdigit() else f'⟨{key}⟩'}"


def table_part(target: str) -> str:
    """What stands before the first colon."""
    return target.partition(":")[0]


def record_id(table: str, key: Column | str) -> Column:
    """A column of ids from a column of keys."""
    return F.concat(F.lit(f"{table}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def id_key(id_: Column | str) -> Column:
    """The key of a column of ids, as text."""
    own = F.col(id_) if isinstance(id_, str) else id_
    return F.substring_index(own, ":", -1)
