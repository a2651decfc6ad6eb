"""Settings from the environment and an env file, as one immutable value."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from sidelight.sources.files import Collection


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines. A quoted value is verbatim; another ends at white space before a ``#``."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        key, eq, value = line.partition("=")
        if not eq or line.startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        else:
            for mark in (" #", "\t#"):
                value = value.split(mark, 1)[0]
            value = value.strip()
        out[key.strip()] = value
    return out


@dataclass(frozen=True)
class Settings:
    photo_root: str | None = None
    media_root: str | None = None
    media_subdirs: tuple[str, ...] = ()
    output_dir: str = "output"
    api_key: str | None = None
    model: str | None = None
    language: str = "English"
    workers: int = 8
    model_dir: str | None = None
    port: int = 8766
    aliases_file: str | None = None

    @classmethod
    def load(cls, env: dict[str, str] | None = None, env_file: str | None = None) -> Settings:
        """The environment before the file; an empty variable is none."""
        env = dict(os.environ if env is None else env)
        told = parse_env(Path(env_file).read_text(encoding="utf-8")) if env_file and Path(env_file).exists() else {}
        get = lambda key: env.get(key) or told.get(key) or None
        return cls(
            photo_root=get("PHOTO_ROOT"), media_root=get("MEDIA_ROOT"),
            media_subdirs=tuple(s.strip() for s in (get("MEDIA_SUBDIRS") or "").split(",") if s.strip()),
            output_dir=get("SIDELIGHT_OUTPUT_DIR") or "output", api_key=get("OPENROUTER_API_KEY"), model=get("OPENROUTER_MODEL"),
            language=get("TAG_LANGUAGE") or "English", workers=int(get("SIDELIGHT_WORKERS") or 8), model_dir=get("EMBEDDING_MODEL_DIR"),
            port=int(get("WEB_SEARCH_PORT") or 8766), aliases_file=get("GEO_ALIASES_FILE"),
        )

    def require_api_key(self) -> str:
        if not self.api_key:
            raise ValueError("OPENROUTER_API_KEY is not set")
        return self.api_key

    def collections(self) -> list[Collection]:
        """Photos first, then media."""
        out = [Collection("photos", self.photo_root, (), False, "photos")] if self.photo_root else []
        return out + ([Collection("media", self.media_root, self.media_subdirs, True, "media")] if self.media_root else [])
