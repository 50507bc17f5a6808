"""A thin JSON-RPC adapter: one request a line on standard input, one response a line on standard output."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from veilframe import __version__
from veilframe.session import Session

PROTOCOL_VERSION = "2024-11-05"
NAME = "veilframe"
HELP = f"""{NAME} {__version__}: masks sensitive values in files and restores them on the way back.

Reads JSON-RPC requests from standard input; a client starts it, not a person.

Environment:
  VEILFRAME_MAPPINGS      mapping file (default ~/.veilframe/mappings.json)
  VEILFRAME_ROOTS         colon-separated folders that may be touched (default: any)
  VEILFRAME_WORDS         comma-separated extra words to mask
  VEILFRAME_DETECTORS     comma-separated detector names
  VEILFRAME_ALLOW_REVEAL  1 to offer restore_text as well
"""


def error_chain(error: BaseException) -> str:
    """An error's message and those of its causes; a causing error's text is left out where it may quote a document."""
    parts = []
    while error is not None:
        parts.append(str(error) or type(error).__name__)
        error = error.__cause__ if not isinstance(error.__cause__, UnicodeDecodeError | json.JSONDecodeError) else None
    return ": ".join(parts)


def handle(session: Session, message: Any) -> dict | None:
    """The response to a message; None for a notification."""
    if not isinstance(message, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
    method, params = message.get("method") or "", message.get("params") or {}
    failed = None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL_VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": __version__}}
    elif method == "tools/list":
        result = {"tools": session.tools()}
    elif method == "tools/call":
        try:
            result = {"content": [{"type": "text", "text": session.dispatch(params.get("name") or "", params.get("arguments") or {})}]}
        except Exception as e:  # noqa: BLE001  the caller has to see what went wrong
            result = {"content": [{"type": "text", "text": error_chain(e)}], "isError": True}
    elif method == "ping":
        result = {}
    else:
        failed = {"code": -32601, "message": f"unknown method: {method}"}
    if message.get("id") is None:
        return None
    return {"jsonrpc": "2.0", "id": message["id"]} | ({"error": failed} if failed else {"result": result})


def serve(session: Session, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            response = handle(session, json.loads(line))
        except json.JSONDecodeError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e.msg}"}}
        if response is not None:
            out.write(json.dumps(response, ensure_ascii=False) + "\n")
            out.flush()


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    helps, versions = {"-h", "--help", "help"}, {"-V", "--version", "version"}
    if bad := [a for a in arguments if a not in helps | versions]:
        print(f"{NAME}: unexpected argument `{bad[0]}`\n", file=sys.stderr)
        print(HELP)
        return 2
    if helps & set(arguments):
        print(HELP)
        return 0
    if arguments:
        print(f"{NAME} {__version__}")
        return 0
    if sys.stdin.isatty():
        print(f"{NAME}: standard input is a terminal, so no client is attached. See --help.", file=sys.stderr)
        return 2
    serve(Session.from_env(), sys.stdin, sys.stdout)
    return 0
