"""Settings: dataclasses with checks, read from dicts, YAML files (with ${VAR} and ${VAR:default}) or the environment."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


def _check(owner: str, **within: tuple[float, float | None, float]) -> None:
    for name, (low, high, value) in within.items():
        if value < low or (high is not None and value > high):
            raise ValueError(f"{owner}.{name} is {value}, not from {low} to {high if high is not None else 'any'}")


@dataclass(frozen=True)
class Extractor:
    provider: str = "heuristic"
    model: str = "gpt-4-turbo-preview"
    api_key: str = ""
    api_base: str | None = None
    temperature: float = 0.0
    max_tokens: int = 500
    timeout: int = 30
    max_retries: int = 3
    retry_delay: float = 1.0

    def __post_init__(self):
        _check("llm", temperature=(0, 2, self.temperature), max_tokens=(1, None, self.max_tokens), timeout=(1, None, self.timeout), max_retries=(0, None, self.max_retries), retry_delay=(0, None, self.retry_delay))


@dataclass(frozen=True)
class Parsing:
    use_cache: bool = True
    cache_type: str = "memory"
    cache_ttl: int = 86_400
    batch_size: int = 20
    enable_batch_processing: bool = True
    similarity_threshold: float = 0.85
    min_confidence: float = 0.7
    enable_ner: bool = True

    def __post_init__(self):
        _check("parsing", similarity_threshold=(0, 1, self.similarity_threshold), min_confidence=(0, 1, self.min_confidence))


@dataclass(frozen=True)
class PrefixTree:
    max_depth: int = 5
    min_cluster_size: int = 3
    token_delimiter: str = " "
    enable_fuzzy_matching: bool = True
    fuzzy_threshold: float = 0.8

    def __post_init__(self):
        _check("prefix_tree", max_depth=(1, None, self.max_depth), min_cluster_size=(1, None, self.min_cluster_size), fuzzy_threshold=(0, 1, self.fuzzy_threshold))


@dataclass(frozen=True)
class Merging:
    enable_auto_merge: bool = True
    merge_threshold: float = 0.9
    max_edit_distance: int = 3
    merge_above: int = 100

    def __post_init__(self):
        _check("merging", merge_threshold=(0, 1, self.merge_threshold), max_edit_distance=(0, None, self.max_edit_distance))


@dataclass(frozen=True)
class Preprocessing:
    remove_timestamps: bool = False
    remove_ip_addresses: bool = False
    normalize_numbers: bool = True
    normalize_paths: bool = True
    lowercase: bool = False
    remove_duplicates: bool = True


@dataclass(frozen=True)
class Config:
    llm: Extractor = field(default_factory=Extractor)
    parsing: Parsing = field(default_factory=Parsing)
    prefix_tree: PrefixTree = field(default_factory=PrefixTree)
    merging: Merging = field(default_factory=Merging)
    preprocessing: Preprocessing = field(default_factory=Preprocessing)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Unknown sections and keys are ignored."""
        parts = {}
        for f in fields(cls):
            kind = f.default_factory
            known = {x.name for x in fields(kind)}
            parts[f.name] = kind(**{k: v for k, v in (values.get(f.name) or {}).items() if k in known})
        return cls(**parts)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        return cls.from_dict(substituted(yaml.safe_load(Path(path).read_text()) or {}))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))


def substituted(value, env: dict | None = None):
    """${VAR} and ${VAR:default} in strings, also inside lists and dicts; an unset variable without default is empty."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substituted(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), value)
    return value


def load(path: str | None = None, places: tuple[str, ...] = ("config/config.yaml", "config.yaml")) -> Config:
    """The file at path, else the first of `places` that exists, else the environment (LLM_API_KEY, LLM_PROVIDER, LLM_MODEL)."""
    for p in (path,) if path else places:
        if Path(p).exists():
            return Config.from_yaml(p)
    if path:
        raise FileNotFoundError(path)
    named = {k: os.environ[v] for k, v in (("api_key", "LLM_API_KEY"), ("provider", "LLM_PROVIDER"), ("model", "LLM_MODEL")) if v in os.environ}
    return Config.from_dict({"llm": named})


def create_default(path: str) -> Config:
    """Write the default settings to a file."""
    settings = Config()
    settings.to_yaml(path)
    return settings
