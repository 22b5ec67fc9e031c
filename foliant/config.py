"""Settings: defaults, then a YAML file, then the environment."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path

PREFIX = "FOLIANT_"


@dataclasses.dataclass(frozen=True)
class Config:
    data_dir: Path = Path("data")
    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_chunk_size: int = 100
    max_chunk_size: int = 3000
    embeddings_enabled: bool = True
    embeddings_batch_size: int = 32
    extract_academic_metadata: bool = True
    extract_tables: bool = True
    extract_equations: bool = True


def _typed(value: object, like: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes")
    return type(like)(value)  # type: ignore[call-arg]


def load_config(path: str | Path | None = None, env: dict[str, str] | None = None) -> Config:
    """Unknown keys are ignored; a missing file is as none."""
    found: dict[str, object] = {}
    if path and Path(path).exists():
        import yaml

        found |= yaml.safe_load(Path(path).read_text()) or {}
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(PREFIX):
            found[k.removeprefix(PREFIX).lower()] = v
    base = Config()
    return dataclasses.replace(base, **{f.name: _typed(found[f.name], getattr(base, f.name)) for f in dataclasses.fields(base) if f.name in found})
