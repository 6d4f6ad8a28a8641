"""Configuration records: column descriptors, pull and push table specs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

PULL_STAMP = "pull_time"


@dataclass(frozen=True)
class ColumnDescriptor:
    """One column of a source or warehouse table. ``data_type`` is the type name without arguments.

    ``labels`` are the (number, label) pairs of an enum, which are part of its type.
    """

    column_code: str
    data_type: str
    alias_name: str = ""
    is_key: bool = False
    max_length: int = 0
    precision: int = 0
    scale: int = 0
    is_nullable: bool = True
    comment: str = ""
    labels: tuple[tuple[int, str], ...] = ()

    @property
    def output_name(self) -> str:
        return self.alias_name or self.column_code


@dataclass(frozen=True)
class FilterCondition:
    """One watermark entry; ``value`` is text, read by ``data_type``."""

    column: str
    data_type: str
    value: str


@dataclass(frozen=True)
class PullSpec:
    """What to pull: a SELECT with ``?`` marks, the watermark bound to them, and the key columns."""

    dest_table: str
    select_sql: str
    filter_val: tuple[FilterCondition, ...] = ()
    key_columns: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()
    batch: int = 2000
    enabled: bool = True


@dataclass(frozen=True)
class PushSpec:
    """What to push back. Empty ``key_columns`` means truncate-and-insert."""

    source_table: str
    dest_table: str
    select_sql: str
    filter_val: tuple[FilterCondition, ...] = ()
    key_columns: tuple[str, ...] = ()
    order_columns: tuple[str, ...] = ()
    batch: int = 2000
    enabled: bool = True
    insert_columns: tuple[str, ...] = field(default_factory=tuple)


def conditions_to_json(conditions) -> str:
    rows = []
    for c in conditions:
        d = asdict(c)
        rows.append({"column": d["column"], "dataType": d["data_type"], "value": d["value"]})
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def conditions_from_json(text: str) -> tuple[FilterCondition, ...]:
    if not text:
        return ()
    return tuple(FilterCondition(r["column"], r["dataType"], r["value"]) for r in json.loads(text))
