"""Settings from the environment, read once a process."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

PREFIX = "VAKTAVYA_"


@dataclass(frozen=True)
class Settings:
    """Everything that can be set, with its default."""

    least_likeness: float = 60.0
    allow_unverified_numbers: bool = False
    judged_share: float = 1.0
    judge: str = "silent"
    judge_attempts: int = 2
    cache_dir: str = "outputs/cache"
    recogniser_attempts: int = 2
    parallel: int = 8
    interval_seconds: float = 0.0
    batch_size: int = 16

    def cache_path(self, name: str, model: str, version: str) -> str:
        """Folder of a judge's answers: model and version of the question are part of it."""
        slug = "".join(c if c.isalnum() or c in "-." else "_" for c in model.lower())
        return f"{self.cache_dir}/{name}/model={slug}/version={version}"


def read_dotenv(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments and blank lines don't count, outer quotes go. No file: nothing."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                found[name.strip()] = value[1:-1] if quoted else value
    return found


def settings_from(env: Mapping[str, str]) -> Settings:
    """Settings of an environment; names are those of the fields in capitals after PREFIX."""
    given = {}
    for name, kind in Settings.__annotations__.items():
        raw = env.get(PREFIX + name.upper())
        if raw is not None:
            text = raw.strip()
            given[name] = text.lower() in ("1", "true", "yes", "on") if kind == "bool" else {"float": float, "int": int}.get(kind, str)(text)
    return Settings(**given)


@lru_cache(1)
def settings() -> Settings:
    """The settings of this process; the environment wins over the file .env."""
    return settings_from({**read_dotenv(".env"), **os.environ})
