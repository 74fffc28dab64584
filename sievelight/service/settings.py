"""Settings from the command line, the environment and a file, in this order."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

NAME = "sievelight"
ENDPOINT_VARS = ("SIEVELIGHT_ENDPOINT", "SIEVELIGHT_BASE_URL")
HOST_VARS = ("SIEVELIGHT_HOST",)
MODEL_VAR, CACHE_VAR = "SIEVELIGHT_MODEL", "SIEVELIGHT_CACHE_DIR"
LOOPBACK, PORT = "127.0.0.1", 8034


def first_set(names, env) -> str | None:
    """The first variable that is set to more than blanks, trimmed."""
    return next((v for v in ((env.get(n) or "").strip() for n in names) if v), None)


def config_path(env=os.environ, home: Path | None = None) -> Path:
    base = env.get("XDG_CONFIG_HOME")
    return (Path(base) if base else (home or Path.home()) / ".config") / NAME / "config.json"


def cache_dir(env=os.environ, platform: str = sys.platform, home: Path | None = None) -> Path:
    """The user's cache folder; never inside a searched tree."""
    home = home or Path.home()
    if env.get(CACHE_VAR):
        return Path(env[CACHE_VAR])
    if platform.startswith("win"):
        return Path(env.get("LOCALAPPDATA") or home / "AppData" / "Local") / NAME
    if platform == "darwin":
        return home / "Library" / "Caches" / NAME
    return Path(env.get("XDG_CACHE_HOME") or home / ".cache") / NAME


def load(path: Path | None = None) -> dict:
    """The settings file as a dict: JSON, or plain `key: value` lines; {} if it is missing or cannot be read."""
    try:
        text = (path or config_path()).read_text(encoding="utf-8")
    except OSError:
        return {}
    try:
        data = json.loads(text)
        return data if isinstance(data, dict) else {}
    except ValueError:
        pairs = (line.partition(":") for line in map(str.strip, text.splitlines()) if line and not line.startswith("#"))
        return {k.strip(): v.strip().strip("'\"") for k, colon, v in pairs if colon}


def save(values: dict, path: Path | None = None) -> Path:
    path = path or config_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(values, indent=2) + "\n", encoding="utf-8")
    return path


def resolve(model: str | None = None, base_url: str | None = None, values: dict | None = None, env=os.environ) -> tuple[str | None, str | None]:
    """(model, base URL): arguments, then the environment, then the file, where a model can have an endpoint of its own.  A host alone
    names a server at the usual port."""
    values = load() if values is None else values
    model = model or env.get(MODEL_VAR) or values.get("model") or values.get("default_model")
    own = values.get("endpoints") if isinstance(values.get("endpoints"), dict) else {}
    host = first_set(HOST_VARS, env)
    url = base_url or first_set(ENDPOINT_VARS, env) or own.get((model or "").lower()) or values.get("base_url")
    return model, url or (f"http://{host}:{PORT}/v1" if host and host != LOOPBACK else None)
