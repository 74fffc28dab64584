"""A line protocol: one JSON-RPC 2.0 message, or an array of them, per line.

A tool is a function of its arguments that returns text, or raises ToolFailure for an answer that says what is missing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .. import __name__ as NAME

PROTOCOL = "2024-11-05"
# Error codes of JSON-RPC 2.0.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32600, -32601, -32602, -32603


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class ToolFailure(Exception):
    """The tool ran, and its answer is that it cannot serve the call."""


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    call: Callable[..., str]
    required: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)

    def listing(self) -> dict:
        return {"name": self.name, "description": self.about, "inputSchema": {"type": "object", "properties": self.properties, "required": list(self.required)}}


class Server:
    def __init__(self, tools: Iterable[Tool], version: str = "1"):
        self.tools, self.version = {t.name: t for t in tools}, version
        self.methods = {"initialize": self._initialize, "ping": lambda _: {}, "tools/list": lambda _: {"tools": [t.listing() for t in self.tools.values()]}, "tools/call": self._call}

    def _initialize(self, _):
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": self.version}}

    def _call(self, params: dict):
        tool = self.tools.get(params.get("name"))
        if tool is None:
            raise RpcError(METHOD_NOT_FOUND, f"unknown tool: {params.get('name')}")
        arguments = params.get("arguments") or {}
        missing = [k for k in tool.required if not str(arguments.get(k) or "").strip()]
        if missing:
            raise RpcError(INVALID_PARAMS, f"missing: {', '.join(missing)}")
        try:
            text, failed = tool.call(**{k: v for k, v in arguments.items() if k in tool.properties}), False
        except ToolFailure as e:
            text, failed = str(e), True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def handle(self, message) -> dict | None:
        """The reply to one message; None for a notification, which gets none."""
        if not isinstance(message, dict):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "a request is an object"}}
        number, silent = message.get("id"), message.get("id") is None
        try:
            name = message.get("method")
            if not isinstance(name, str):
                raise RpcError(INVALID_REQUEST, "no method")
            if name not in self.methods:
                raise RpcError(METHOD_NOT_FOUND, f"no such method: {name}")
            reply = {"result": self.methods[name](message.get("params") or {})}
        except RpcError as e:
            reply = {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # a tool's own fault is the caller's answer, not the server's end
            reply = {"error": {"code": INTERNAL_ERROR, "message": str(e)}}
        return None if silent else {"jsonrpc": "2.0", "id": number, **reply}

    def serve(self, lines: Iterable[str], out) -> None:
        """Answer lines in their order."""
        for line in filter(None, map(str.strip, lines)):
            try:
                message = json.loads(line)
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}}
            else:
                reply = [r for r in map(self.handle, message) if r] if isinstance(message, list) else self.handle(message)
            if reply:
                out.write(json.dumps(reply) + "\n")
                out.flush()
