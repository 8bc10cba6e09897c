"""A small dashboard on the loopback interface: HTML for people, JSON for programs.

Only requests whose Host is the loopback are answered. The one write, marking
sessions as reviewed, needs a token that only the page itself has, and an Origin
that is the page's.
"""

from __future__ import annotations

import hmac
import html
import json
import secrets
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..operators.trace import SessionNotFound
from ..sources.ledgers import update_reviewed
from .engine import Engine
from .store import StoreError

LOOPBACK = ("127.0.0.1", "localhost", "::1")
KEEP_SECONDS = 60
MOST_BYTES = 65_536
PAGES = ("overview", "orphans", "memory", "denials")


def host_allowed(host: str | None) -> bool:
    return bool(host) and urlsplit(f"//{host}").hostname in LOOPBACK


class Cache:
    """One computation at a time for each name; an answer is kept for a while."""

    def __init__(self, seconds: float = KEEP_SECONDS):
        self.seconds, self.held, self.locks, self.guard = seconds, {}, {}, threading.Lock()

    def get(self, name: str, make: Callable):
        with self.guard:
            lock = self.locks.setdefault(name, threading.Lock())
        with lock:
            at, value = self.held.get(name, (0.0, None))
            if time.monotonic() - at > self.seconds or not at:
                value = make()
                self.held[name] = (time.monotonic(), value)
            return value

    def drop(self) -> None:
        self.held.clear()


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


class Dashboard:
    def __init__(self, engine: Engine, reviewed: str | None = None):
        self.engine, self.reviewed, self.token, self.cache = engine, reviewed, secrets.token_urlsafe(24), Cache()

    def data(self, name: str):
        e = self.engine
        make = {
            "info": lambda: e.info(),
            "overview": lambda: {"info": e.info(), "hygiene": rows(e.hygiene()["categories"])},
            "orphans": lambda: rows(e.orphans(reviewed=self.reviewed)),
            "memory": lambda: {k: rows(v) for k, v in e.memory_authors().items()},
            "denials": lambda: rows(e.denials()),
        }
        return self.cache.get(name, make[name])

    def session(self, prefix: str) -> dict:
        got = self.engine.session_trace(prefix)
        return {**got, "timeline": rows(got["timeline"])}

    def page(self, title: str, value) -> str:
        def draw(v) -> str:
            if isinstance(v, dict):
                return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{draw(x)}</td></tr>" for k, x in v.items()) + "</table>"
            if isinstance(v, list):
                return "<ol>" + "".join(f"<li>{draw(x)}</li>" for x in v) + "</ol>"
            return html.escape("" if v is None else str(v))

        links = " ".join(f'<a href="/{"" if p == "overview" else p}">{p}</a>' for p in PAGES)
        form = f'<form method="post" action="/orphans/reviewed"><input type="hidden" name="token" value="{self.token}"><input name="session"><button>reviewed</button></form>' if title == "orphans" and self.reviewed else ""
        return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><nav>{links}</nav><h1>{html.escape(title)}</h1>{form}{draw(value)}"

    def get(self, path: str) -> tuple[int, str, str]:
        """Status, content type and body."""
        path = urlsplit(path).path
        if path == "/healthz":
            return 200, "text/plain", "ok"
        try:
            if path.startswith("/session/"):
                return 200, "text/html", self.page("session", self.session(path[9:]))
            if path.startswith("/api/") and path.endswith(".json") and (name := path[5:-5]) in (*PAGES, "info"):
                return 200, "application/json", json.dumps(self.data(name), ensure_ascii=False, default=str)
            name = path.strip("/") or "overview"
            if name in PAGES:
                return 200, "text/html", self.page(name, self.data(name))
        except SessionNotFound as e:
            return 404, "text/plain", str(e)
        except StoreError as e:
            return 503, "text/plain", str(e)
        return 404, "text/plain", "no such page"

    def post(self, path: str, origin: str | None, body: bytes) -> tuple[int, str, str]:
        form = parse_qs(body.decode("utf-8", "replace"))
        if path != "/orphans/reviewed" or not self.reviewed:
            return 404, "text/plain", "no such page"
        if not host_allowed(urlsplit(origin or "").netloc) or not hmac.compare_digest(form.get("token", [""])[0], self.token):
            return 403, "text/plain", "forbidden"
        update_reviewed(self.reviewed, form.get("session", []), form.get("unmark", []))
        self.cache.drop()
        return 303, "text/plain", "/orphans"


def handler(board: Dashboard):
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            if status == 303:
                self.send_header("Location", body)
            if status == 503:
                self.send_header("Retry-After", "30")
            self.end_headers()
            self.wfile.write(data)

        def handled(self, make: Callable) -> None:
            if not host_allowed(self.headers.get("Host")):
                return self.answer(403, "text/plain", "forbidden")
            try:
                self.answer(*make())
            except Exception as e:  # a page's error must not end the server
                self.answer(500, "text/plain", type(e).__name__)

        def do_GET(self) -> None:  # noqa: N802
            self.handled(lambda: board.get(self.path))

        def do_POST(self) -> None:  # noqa: N802
            size = self.headers.get("Content-Length", "")
            if not size.isdigit() or int(size) > MOST_BYTES:
                return self.answer(413, "text/plain", "too long")
            body = self.rfile.read(int(size))
            self.handled(lambda: board.post(urlsplit(self.path).path, self.headers.get("Origin"), body))

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8787, reviewed: str | None = None) -> None:
    if host not in LOOPBACK:
        raise ValueError("the dashboard is served on the loopback interface only")
    with ThreadingHTTPServer((host, port), handler(Dashboard(engine, reviewed))) as server:
        print(f"http://{host}:{server.server_port}/", flush=True)
        server.serve_forever()
