"""Settings from YAML, read leniently: values of a wrong kind fall back to the default, unknown keys are kept apart."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import yaml

# Defaults of the settings.
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


@dataclass
class Settings:
    strategy: str = "rerank(bm25)"
    k: int = 5
    rrf_k: int = 60
    max_candidates: int = 30
    max_relevant: int = 5
    chunk_size: int = 2000
    overlap_paragraphs: int = 1
    top_k: int = 5
    similarity_threshold: float = 0.8
    scope: str = "pages"
    embed_frontmatter: bool = False
    source_chars: int = 200_000
    extra: dict = field(default_factory=dict)


def as_bool(value, default: bool) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    return True if text in TRUE else False if text in FALSE else default


def as_number(value, default):
    try:
        return type(default)(value) if not isinstance(value, bool) else default
    except (TypeError, ValueError):
        return default


def load(text: str) -> Settings:
    """Settings of a YAML text; text that is no mapping gives the defaults."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        data = None
    out = Settings()
    if not isinstance(data, dict):
        return out
    for f in fields(Settings):
        if f.name != "extra" and f.name in data:
            value, default = data[f.name], getattr(out, f.name)
            setattr(out, f.name, as_bool(value, default) if isinstance(default, bool) else as_number(value, default) if isinstance(default, int | float) else value if isinstance(value, str) else default)
    known = {f.name for f in fields(Settings)}
    out.extra = {k: v for k, v in data.items() if k not in known}
    return out


def merged(settings: Settings, **overrides) -> Settings:
    """Settings with the overrides that are given and known; null ones leave a setting as it is."""
    names = {f.name for f in fields(Settings)} - {"extra"}
    unknown = sorted(set(overrides) - names)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(settings, **{k: v for k, v in overrides.items() if v is not None})


def upserted(text: str, block: str, values: dict) -> str:
    """A YAML text whose top-level mapping `block` holds the values, all else as it is written; the block is put at the end if it is missing."""
    lines = text.splitlines()
    start = next((n for n, line in enumerate(lines) if line.split("#")[0].rstrip() == f"{block}:"), None)
    held = yaml.safe_load(text) if text.strip() else {}
    old = held.get(block) if isinstance(held, dict) and isinstance(held.get(block), dict) else {}
    new = yaml.safe_dump({block: {**old, **values}}, sort_keys=False, allow_unicode=True).rstrip("\n").split("\n")
    if start is None:
        return "\n".join([*lines, *new]) + "\n"
    end = start + 1
    while end < len(lines) and (not lines[end].strip() or lines[end][0] in " #"):
        end += 1
    while lines[end - 1].strip() == "" or lines[end - 1].startswith("#"):
        end -= 1
    return "\n".join([*lines[:start], *new, *lines[end:]]) + "\n"
