"""Side-by-side comparison of a Spark query and its SQL twin in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path
from typing import Any

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings episodes triples chunks "
    "parent_chunks raw_triples tombstones doc_grades mix_targets pack_sizes"
).split()


def connect(sf_dir: str) -> Any:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            source = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value: Any) -> Any:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def difference(df: Any, con: Any, sql: str) -> str | None:
    """What differs, or None. Columns are matched by name, rows as a multiset."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    ours = Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())
    order = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in rel.fetchall())
    if ours == theirs:
        return None
    more, less = ours - theirs, theirs - ours
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only Spark: {list(more.items())[:3]}; only SQL: {list(less.items())[:3]}"
