"""Immutable settings; domain data (allowlist, aliases, lexicons) is configuration too."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields, is_dataclass, replace
from functools import lru_cache
from pathlib import Path


#: Elements of a page that are never main text.
DROP_SELECTORS = ("nav", "header", "footer", "aside", "[data-testid*='compare']", "[class*='return-calculator']", "[class*='understand-terms']")


@dataclass(frozen=True)
class Source:
    """One allowed page and the entity it describes."""

    scheme_id: str
    category: str
    scheme_name: str
    url: str

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*", self.scheme_id or ""):
            raise ValueError(f"scheme_id must be a slug: {self.scheme_id!r}")


@dataclass(frozen=True)
class Settings:
    house: str = "the house"
    sources: tuple[Source, ...] = ()
    min_text_chars: int = 1500
    drop_selectors: tuple[str, ...] = DROP_SELECTORS
    noise_window: int = 400
    chunk_tokens: int = 200
    overlap_tokens: int = 40
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    strategy: str = "auto"
    semantic_available: bool = True
    holdings_mode: str = "sector_summary"
    dim: int = 384
    max_sequence: int = 256
    safety_margin: int = 24
    prefix_template: str = "{scheme_name} ({category}). {text}"
    top_k: int = 6
    oversample: int = 3
    final_k: int = 4
    mmr_lambda: float = 0.3
    max_per_field: int = 3
    floor: float = 0.30
    cluster_distance: float = 0.25
    max_query_chars: int = 500
    history_turns: int = 10
    max_sentences: int = 3
    retries: int = 1
    temperature: float = 0.0
    generator_tokens: int = 220

    def __post_init__(self):
        ids = [s.scheme_id for s in self.sources]
        if len(set(ids)) != len(ids):
            raise ValueError("scheme_id values must be unique")
        if self.strategy not in ("auto", "label_aware_recursive", "semantic"):
            raise ValueError(f"unknown chunking strategy {self.strategy!r}")

    @property
    def candidate_k(self) -> int:
        return self.top_k * self.oversample

    @property
    def token_budget(self) -> int:
        """Tokens an embedding input may have: two are the model's own."""
        return self.max_sequence - 2 - self.safety_margin

    def render_prefix(self, scheme_name: str, category: str, text: str) -> str:
        return self.prefix_template.format(scheme_name=scheme_name, category=category, text=text)

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


def settings_from(data: dict) -> Settings:
    """Settings of a plain map; unknown keys are errors."""
    known = {f.name for f in fields(Settings)}
    if extra := set(data) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    made = dict(data)
    if "sources" in made:
        made["sources"] = tuple(s if is_dataclass(s) else Source(**s) for s in made["sources"])
    for name in ("separators", "drop_selectors"):
        if name in made:
            made[name] = tuple(made[name])
    return Settings(**made)


@lru_cache(maxsize=16)
def _loaded(path: str) -> Settings:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return settings_from(json.loads(text))
    import yaml

    return settings_from(yaml.safe_load(text) or {})


def load_settings(path: str) -> Settings:
    """A YAML or JSON settings file, validated; kept by resolved path."""
    return _loaded(str(Path(path).resolve()))


def clear_settings_cache() -> None:
    _loaded.cache_clear()
