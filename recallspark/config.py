"""Settings of the engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 3
    parent_size: int = 8
    working_memory: int = 10
    use_bm25: bool = True
    use_spreading: bool = True
    use_vectors: bool = True
    use_reranker: bool = False
    use_parents: bool = False
    use_decomposition: bool = False
    decay: float = 0.5
    max_hops: int = 2
    threshold: float = 0.1
    budget: float = 10.0

    @classmethod
    def from_tree(cls, tree: Mapping[str, Any], block: str = "memory") -> EngineConfig:
        """From a nested mapping as a YAML file gives it; names it does not know are left alone."""
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in (tree.get(block) or {}).items() if k in known})
