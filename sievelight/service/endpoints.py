"""Model servers: their addresses, who answers on a host, and which prompt profile a model takes.

Every function that would call a server takes the call as an argument: get(url) and post(url, body) return parsed JSON, or None
where nothing answers."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

PORTS = tuple(range(8033, 8041))
#: Ports asked first, in this order, when no model is wanted by name.
PREFERRED = (8034, 8033)
# Names that select a profile, and words in a served model's name.
ALIASES = {
    "lfm": "lfm lfm2 lfm2.5 lfm-2.5 liquid",
    "qwen": "qwen qwen2 qwen2.5 qwen3 qwen3.8 qwq",
    "gemma": "gemma gemma2 gemma3",
    "rwkv": "rwkv rwkv5 rwkv6 rwkv7",
    "openai": "openai generic ollama vllm tabbyapi",
}
SERVED = (("qwen", ("qwen", "qwq")), ("lfm", ("lfm", "liquid")), ("gemma", ("gemma",)), ("rwkv", ("rwkv",)))
PORT_PROFILES = {8034: "lfm", 8033: "qwen", 8000: "rwkv", 11434: "openai"}


def fetch(url: str, body: dict | None = None, timeout: float = 2.0):
    """Parsed JSON of a GET, or a POST with a body; None for anything but a good answer."""
    data = None if body is None else json.dumps(body).encode()
    try:
        with urlopen(Request(url, data, {"Content-Type": "application/json", "Accept": "application/json"}), timeout=timeout) as r:
            return json.loads(r.read().decode()) if r.status == 200 else None
    except (OSError, ValueError):
        return None


def addresses(base: str) -> dict[str, str]:
    """completion, chat, models and tokenize of a base URL, whichever of them it names itself."""
    root = base.rstrip("/")
    for end in ("/v1/chat/completions", "/v1/models", "/completion", "/tokenize", "/v1"):
        if root.endswith(end):
            root = root[: -len(end)].rstrip("/")
            break
    return {"completion": f"{root}/completion", "chat": f"{root}/v1/chat/completions", "models": f"{root}/v1/models", "tokenize": f"{root}/tokenize"}


def reply_text(data) -> str:
    """The text of a completion, legacy or chat reply; empty for anything else."""
    if not isinstance(data, dict):
        return ""
    choice = next(iter(data.get("choices") or []), {})
    message = choice.get("message") or {}
    return next((x for x in (data.get("content"), choice.get("text"), message.get("content")) if isinstance(x, str)), "")


def model_names(listing) -> list[str]:
    """Names of a /models reply, in the shapes that servers use."""
    rows = [x for k in ("data", "models") for x in ((listing or {}).get(k) or []) if isinstance(x, dict)]
    return [str(x[k]) for x in rows for k in ("id", "name", "model") if k in x]


def profile_name(name: str) -> str:
    """The profile of a name or alias; an unknown name is a generic server's."""
    low = name.strip().lower()
    return next((p for p, names in ALIASES.items() if low in names.split()), "openai")


def profile_of_models(names) -> str | None:
    for name in names:
        for profile, words in SERVED:
            if any(w in name.lower() for w in words):
                return profile
    return "openai" if names else None


def detect_profile(base: str, get=fetch) -> str:
    """By the served models, else by the port, else the first profile."""
    known = profile_of_models(model_names(get(addresses(base)["models"])))
    return known or next((p for port, p in PORT_PROFILES.items() if f":{port}" in base), "lfm")


def token_ids(base: str, words, post=fetch) -> set[int]:
    """Ids of words that a server's tokenizer gives as one token; empty if it has none to ask."""
    found = set()
    for word in words:
        tokens = (post(addresses(base)["tokenize"], {"content": word}) or {}).get("tokens") or []
        if len(tokens) == 1:
            found.add(int(tokens[0]["id"] if isinstance(tokens[0], dict) else tokens[0]))
    return found


def discover(host: str, ports=PORTS, wanted: str | None = None, pinned: str | None = None, get=fetch) -> dict:
    """Which server to use: {url, port, model}, or {url: None, reason}.

    A pinned URL is taken as it is.  Else all ports are asked at once; a wanted model's server comes first, then the
    preferred ports, then the lowest.  What did not answer is never returned."""
    if pinned:
        return {"url": pinned, "port": None, "model": None}

    def ask(port):
        listing = get(f"http://{host}:{port}/v1/models")
        return None if listing is None else {"url": f"http://{host}:{port}/v1", "port": port, "model": next(iter(model_names(listing)), "unknown")}

    with ThreadPoolExecutor(max(1, len(ports))) as pool:
        alive = [x for x in pool.map(ask, ports) if x]
    if not alive:
        return {"url": None, "reason": f"no model server answered on {host}, ports {min(ports, default=0)} to {max(ports, default=0)}; name one by its URL"}
    named = [x for x in alive if wanted and wanted.lower() in x["model"].lower()]
    liked = [x for p in PREFERRED for x in alive if x["port"] == p]
    return (named + liked + alive)[0]
