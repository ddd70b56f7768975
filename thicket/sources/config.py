"""Configuration (survey ids SRC-12, SRC-13, TXT-18): a TOML file, with values from the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from thicket.operators.extract import Domain
from thicket.schema import DEFAULT_TENANT


@dataclass
class Config:
    provider: str = "rules"
    models: dict[str, str] = field(default_factory=dict)
    api_keys: dict[str, str] = field(default_factory=dict)
    chunk_size: int = 1500
    chunk_overlap: int = 150
    tenant: str = DEFAULT_TENANT
    warehouse: str = "warehouse"
    domain: Domain | None = None


def expand(value: str, env: Mapping[str, str] = os.environ) -> str:
    """TXT-18: the variable's value for ${NAME} or $NAME as the whole value (empty if unset); else the value."""
    if value.startswith("${") and value.endswith("}"):
        return env.get(value[2:-1], "")
    return env.get(value[1:], "") if value.startswith("$") and len(value) > 1 else value


def load_config(path: str, env: Mapping[str, str] = os.environ) -> Config:
    """SRC-12. Keys: default_provider, chunk_size, chunk_overlap, tenant, warehouse; tables providers.<name> (api_key,
    model) and domain (name, context, entity_types, focus). A google key falls back on GEMINI_API_KEY."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    out = Config(**{k: raw[k] for k in ("chunk_size", "chunk_overlap", "tenant", "warehouse") if k in raw}, provider=raw.get("default_provider", Config.provider))
    for name, table in raw.get("providers", {}).items():
        if "model" in table:
            out.models[name] = table["model"]
        if "api_key" in table:
            out.api_keys[name] = expand(table["api_key"], env)
    if not out.api_keys.get("google") and env.get("GEMINI_API_KEY"):
        out.api_keys["google"] = env["GEMINI_API_KEY"]
    if d := raw.get("domain"):
        out.domain = Domain(d.get("name"), d.get("context"), list(d.get("entity_types", [])), d.get("focus"))
    return out


def with_context_file(context: str | None, path: str | None) -> str | None:
    """SRC-13: the context, a blank line, the file's text."""
    if path is None:
        return context
    text = Path(path).read_text(encoding="utf-8")
    return f"{context}\n\n{text}" if context else text
