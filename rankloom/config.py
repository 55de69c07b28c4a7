"""Typed settings with environment and ``.env`` overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

ENV_PREFIX = "RANKLOOM_"


@dataclass(frozen=True)
class EngineConfig:
    """All tunables; ranges are checked on construction."""

    embedding_model_name: str = "sentence-transformers/all-MiniLM-L6-v2"
    reranker_model_name: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"
    nli_model_name: str = "cross-encoder/nli-deberta-v3-xsmall"
    top_k: int = 10
    rerank_top_k: int = 5
    rrf_k: int = 60
    hybrid_alpha: float = 0.5
    generation_enabled: bool = False
    generation_api_key: str | None = None
    generation_model: str = "default"
    data_dir: str = "data"
    reports_dir: str = "reports"

    def __post_init__(self) -> None:
        for name in ("top_k", "rerank_top_k", "rrf_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, got {getattr(self, name)}")
        if not 0.0 <= self.hybrid_alpha <= 1.0:
            raise ValueError(f"hybrid_alpha must lie in [0, 1], got {self.hybrid_alpha}")

    def masked_key(self) -> str:
        """The API key with everything after its first six characters hidden."""
        key = self.generation_api_key
        return "(not set)" if not key else key[:6] + "*" * max(0, len(key) - 6)


_CASTS = {
    "int": int,
    "float": float,
    "bool": lambda raw: raw.strip().lower() in {"1", "true", "yes", "on"},
    "str": str,
    "str | None": str,
}


def _dotenv(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text(encoding="utf-8").splitlines()
             if "=" in line and not line.lstrip().startswith("#"))
    return {key.strip(): value.strip().strip("\"'") for key, value in pairs}


def config_from_env(env: dict[str, str] | None = None, dotenv: str = ".env") -> EngineConfig:
    """Settings from ``RANKLOOM_*`` variables; the process beats ``.env``; unknown names are ignored."""
    source = {**_dotenv(Path(dotenv)), **(os.environ if env is None else env)}
    chosen = {}
    for field in fields(EngineConfig):
        raw = source.get(ENV_PREFIX + field.name.upper())
        if raw is not None:
            chosen[field.name] = _CASTS[str(field.type)](raw)
    return EngineConfig(**chosen)


@lru_cache(maxsize=1)
def get_config() -> EngineConfig:
    return config_from_env()
