"""Settings from the environment or a file of KEY=VALUE lines; a bad one stops the start and is named."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields
from pathlib import Path


def read_env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines; blank lines, comments and lines without a sign are skipped, quotes around values dropped."""
    file, found = Path(path), {}
    for line in file.read_text().splitlines() if file.exists() else ():
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("\"'")
    return found


@dataclass(frozen=True)
class Settings:
    """Limits of the chat service; all must be positive and finite."""

    rate_limit_per_minute: int = 5
    max_question_chars: int = 2000
    spend_cap_usd: float = 1.5
    answer_timeout_seconds: float = 60.0
    collection: str = "chunks"

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            try:
                values[f.name] = kind(raw)
            except ValueError:
                raise ValueError(f"{f.name.upper()} is not a number: {raw!r}") from None
            if kind is str and not raw.strip():
                raise ValueError(f"{f.name.upper()} is empty")
            if kind is not str and not (values[f.name] > 0 and math.isfinite(values[f.name])):
                raise ValueError(f"{f.name.upper()} must be positive and finite: {raw!r}")
        return cls(**values)
