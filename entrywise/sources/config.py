"""Configuration: stores that extend others, aliases, types of extended attributes.

Files are JSON, or YAML where a YAML library is installed. Values are looked up
by dotted names; `${NAME}` in a string is taken from the environment.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import UsageError

#: Declared types of extended attributes and the SQL types that hold them without wrapping.
TYPES = {"boolean": "boolean", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "string": "string", "binary": "binary"}
UNSIGNED = {"uint32": (1 << 32) - 1, "uint64": (1 << 64) - 1}


def _from_environment(value):
    if isinstance(value, dict):
        return {k: _from_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_from_environment(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    return value


@dataclass
class Config:
    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Config":
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            values = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError:
                raise UsageError(f"{path} is not JSON, and no YAML library is installed") from None
            values = yaml.safe_load(text)
        if not isinstance(values, dict):
            raise UsageError(f"{path} holds no mapping")
        return cls(_from_environment(values))

    def get(self, name: str, default=None):
        """A value by its dotted name; the longest matching key goes first, as keys may hold dots."""
        return _lookup(self.values, name.split("."), default)

    def backend(self, name: str) -> dict:
        """A store's settings over those of the stores it extends; its enrichers come after theirs."""
        seen, chain = [], []
        while name:
            if name in seen:
                raise UsageError(f"stores extend each other: {' -> '.join([*seen, name])}")
            seen.append(name)
            mine = self.values.get("backends", {}).get(name)
            if mine is None:
                if len(seen) > 1:
                    break  # the last one is a built-in store
                raise UsageError(f"no such store: {name!r}")
            chain.append(mine)
            name = mine.get("extends")
        out: dict = {"plugin": seen[-1]}
        for part in reversed(chain):
            enrichers = [*out.get("enrichers", []), *(e for e in part.get("enrichers", []) if e not in out.get("enrichers", []))]
            out |= part
            if enrichers:
                out["enrichers"] = enrichers
        return out

    def aliases(self) -> dict[str, list[str]]:
        return {k: v.split() if isinstance(v, str) else list(v) for k, v in self.values.get("alias", {}).items()}


def _lookup(values, parts: list[str], default):
    for n in range(len(parts), 0, -1):
        key = ".".join(parts[:n])
        if isinstance(values, dict) and key in values:
            return values[key] if n == len(parts) else _lookup(values[key], parts[n:], default)
    return default


def typed_xattrs(df: DataFrame, types: dict[str, str], xattrs: str = "xattrs") -> DataFrame:
    """Columns for declared attributes of a MAP<STRING, STRING>, and `bad_xattrs`, the names whose values don't fit."""
    for name, kind in types.items():
        if kind not in TYPES:
            raise UsageError(f"attribute {name} can't be declared {kind}")
    columns, bad = {}, []
    for name, kind in types.items():
        raw = F.try_element_at(F.col(xattrs), F.lit(name))
        value = raw if kind == "string" else raw.try_cast(TYPES[kind])
        if kind in UNSIGNED:
            value = F.when((value >= 0) & (value <= UNSIGNED[kind]), value)
        columns[name.rpartition(".")[2]] = value
        bad.append(F.when(raw.isNotNull() & value.isNull(), F.lit(name)))
    return df.withColumns({**columns, "bad_xattrs": F.array_compact(F.array(*bad))})
