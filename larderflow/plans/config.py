"""Settings: a TOML file, overridden by environment variables."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

from ..operators.model_calls import Provider, provider
from ..sources.transport import Transport

PREFIX = "LARDERFLOW"


@dataclass
class Settings:
    default_provider: str = "open_ai"
    timeout: float = 30
    providers: dict[str, dict[str, Any]] = field(default_factory=dict)
    fallback_enabled: bool = False
    fallback_order: list[str] = field(default_factory=list)
    retry_attempts: int = 3
    retry_delay_ms: int = 1000
    extractors: tuple[str, ...] = ("jsonld", "microdata", "html_class")
    browser_url: str | None = None
    browser_domains: list[str] = field(default_factory=list)

    def transport(self) -> Transport:
        """HTTP with these settings' timeout, and their retries where fallback is on."""
        return Transport(timeout=self.timeout, attempts=self.retry_attempts if self.fallback_enabled else 1, delay_ms=self.retry_delay_ms)


def _typed(s: str) -> Any:
    """A variable's text as a boolean, a number or a text."""
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = PREFIX) -> Settings:
    """Settings of the file, if it is there, under those of PREFIX__SECTION__KEY variables."""
    tree: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            tree = tomllib.load(f)
    for name, value in sorted((os.environ if env is None else env).items()):
        if name.startswith(f"{prefix}__"):
            *where, last = name[len(prefix) + 2 :].lower().split("__")
            at = tree
            for w in where:
                at = at.setdefault(w, {})
            at[last] = _typed(value)
    fb, br, ex = tree.get("fallback", {}), tree.get("browser", {}), tree.get("extractors", {})
    domains = br.get("domains", [])
    return Settings(
        default_provider=tree.get("default_provider", "open_ai"), timeout=float(tree.get("timeout", 30)), providers=tree.get("providers", {}),
        fallback_enabled=bool(fb.get("enabled", False)), fallback_order=list(fb.get("order", [])), retry_attempts=int(fb.get("retry_attempts", 3)), retry_delay_ms=int(fb.get("retry_delay_ms", 1000)),
        extractors=tuple({"json_ld": "jsonld"}.get(x, x) for x in ex.get("order", ("jsonld", "microdata", "html_class"))),
        browser_url=br.get("url"), browser_domains=domains.split(",") if isinstance(domains, str) else list(domains),
    )


def resolve(settings: Settings, name: str | None = None, model: str | None = None) -> Provider:
    """The provider: what the caller names comes before the settings, those before the defaults. Without settings of its own a provider may give 4000 tokens, else 2000."""
    name = name or settings.default_provider
    own = settings.providers.get(name)
    how: dict[str, Any] = {"model": model or (own or {}).get("model")}
    if own is not None:
        how |= {"temperature": float(own.get("temperature", 0.7)), "max_tokens": int(own.get("max_tokens", 2000)), "options": {k: str(v) for k, v in own.items() if k in ("base_url", "endpoint", "deployment_name", "api_version", "project_id")}}
    p = provider(name, **how)
    if p is None:
        raise ValueError(f"no provider {name!r} with these settings")
    return p


def chain(settings: Settings, name: str | None = None, model: str | None = None) -> list[Provider]:
    """The provider, and where fallback is on the others in their order."""
    first = resolve(settings, name, model)
    others = [n for n in settings.fallback_order if n != first.name] if settings.fallback_enabled else []
    return [first] + [resolve(settings, n) for n in others]
