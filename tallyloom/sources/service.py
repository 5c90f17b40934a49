"""A small HTTP front: POST {"url": ...} for a project's prompt and grades, GET for health. It runs on the driver, one request at a time.

plans.grading.Grader is the grade that fetches, prompts and asks a provider; requests may set prompt_style, provider and model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

PROJECT = re.compile(r"/projects/(\d+)")


# The keys of an answer.
KEYS = ("status", "url", "prompt_path", "grades")


def payload(url: str, prompt_path: str, grades: dict | None) -> dict:
    return dict(zip(KEYS, ("ok", url, prompt_path, grades), strict=True))


def respond(body: str, grade: Callable[[str, dict], tuple[str, dict | None]]) -> tuple[int, dict]:
    """(HTTP status, answer) to a request's body; grade takes the URL and the whole request, and gives the prompt's path and the grades."""
    try:
        request = json.loads(body) if body else {}
    except ValueError:
        return 400, {"error": "invalid JSON"}
    url = request.get("url") if isinstance(request, dict) else None
    if not url:
        return 400, {"error": "missing url"}
    try:
        return 200, payload(url, *grade(url, request))
    except Exception as e:
        return 500, {"error": str(e)}


def project_id(url: str) -> int | None:
    found = PROJECT.search(url)
    return int(found[1]) if found else None


def server(grade: Callable[[str, dict], tuple[str, dict | None]], port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, what: dict) -> None:
            data = json.dumps(what).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            self._send(*respond(self.rfile.read(int(self.headers.get("Content-Length", "0"))).decode(), grade))

        def do_GET(self) -> None:  # noqa: N802
            self._send(200, {"status": "ok"})

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer(("", port), Handler)
