"""The engine behind HTTP, by the standard library: token, clean, provenance, rollback, health and metrics."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import time
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from rinsework.exports import rows_of
from rinsework.operators.governance import Approvals
from rinsework.operators.loss import Limits
from rinsework.plans.flow import Blocked, clean_documents, clean_table
from rinsework.plans.provenance import sign
from rinsework.sources import documents
from rinsework.sources.formats import read_records
from rinsework.sources.versions import VersionStore

# What each role may do.
ROLES = {"admin": {"clean", "provenance", "rollback"}, "operator": {"clean", "provenance"}, "auditor": {"provenance"}}


class Refused(Exception):
    def __init__(self, status: int, why: Any):
        super().__init__(str(why))
        self.status, self.why = status, why


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unb64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def make_token(user: str, role: str, secret: bytes, seconds: int = 3600) -> str:
    """A JWT, signed by HS256."""
    body = ".".join(_b64(json.dumps(x).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": user, "role": role, "exp": int(time.time()) + seconds}))
    return f"{body}.{_b64(hmac.new(secret, body.encode(), hashlib.sha256).digest())}"


def read_token(token: str, secret: bytes) -> dict[str, Any]:
    try:
        head, body, signature = token.split(".")
        good = hmac.compare_digest(_unb64(signature), hmac.new(secret, f"{head}.{body}".encode(), hashlib.sha256).digest())
        claims = json.loads(_unb64(body))
        if good and json.loads(_unb64(head)).get("alg") == "HS256" and claims["exp"] > time.time():
            return claims
    except (ValueError, KeyError, TypeError):
        pass
    raise Refused(401, "invalid or expired token")


@dataclass
class Service:
    """verify: the role of a user with this password, or None. The secret has no default."""

    spark: SparkSession
    store_uri: str
    secret: bytes
    verify: Callable[[str, str], str | None]
    last: dict[str, Any] = field(default_factory=dict)
    stores: dict[str, VersionStore] = field(default_factory=dict)
    served: dict[str, int] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self) -> None:
        if len(self.secret) < 16:
            raise ValueError("a secret of at least 16 bytes is needed")

    def token(self, user: str, password: str) -> dict[str, str]:
        role = self.verify(user, password)
        if role not in ROLES:
            raise Refused(401, "unknown user or wrong password")
        return {"access_token": make_token(user, role, self.secret), "token_type": "bearer"}

    def allow(self, header: str | None, what: str) -> dict[str, Any]:
        if not header or not header.startswith("Bearer "):
            raise Refused(401, "a token is needed")
        claims = read_token(header[7:], self.secret)
        if what not in ROLES.get(claims.get("role", ""), set()):
            raise Refused(403, f"{claims.get('role')} may not {what}")
        return claims

    def clean(self, records: list[dict[str, Any]], columns: list[str] | None = None, target_loss_limit: float | None = None, approve: bool = False) -> dict[str, Any]:
        try:
            df = read_records(self.spark, records)
        except ValueError as e:
            raise Refused(400, str(e)) from e
        limits = Limits(volumetric=target_loss_limit) if target_loss_limit is not None else Limits()
        store = VersionStore(self.spark, f"{self.store_uri}/{time.time_ns():x}")
        try:
            found, done = clean_table(df, store, columns, approve, limits=limits)
        except Blocked as e:
            raise Refused(422, {"blocked": e.report.reasons}) from e
        with self.lock:
            self.last = {"store": store, "manifest": sign(done.manifest, self.secret), "version": done.version}
        return {"records": rows_of(done.df), "version": done.version, "quality_score": found.score, "steps": [s.as_dict() for s in done.steps], "review": [s.as_dict() for s in found.plan.review], "quarantined": done.quarantined.count()}

    def provenance(self) -> dict[str, Any]:
        if not self.last:
            raise Refused(404, "nothing was cleaned yet")
        return self.last["manifest"]

    def rollback(self, version: int) -> dict[str, Any]:
        if not self.last:
            raise Refused(404, "nothing was cleaned yet")
        with self.lock:
            store: VersionStore = self.last["store"]
            try:
                self.last["version"] = store.restore(version)
            except KeyError as e:
                raise Refused(404, str(e)) from e
        return {"version": self.last["version"], "records": rows_of(store.read())}

    def clean_document(self, filename: str, content: bytes, approve: bool = False) -> dict[str, Any]:
        """One document through the flow; its versions are kept under its id."""
        if not filename:
            raise Refused(400, "a file name is needed")
        try:
            own = documents.parse(filename, content)
        except (ValueError, zipfile.BadZipFile) as e:
            raise Refused(400, f"only .txt, .docx and .pdf within the quota can be read: {e}") from e
        doc_id = filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        row = {"doc_id": doc_id, "path": filename, "n_chars": len(own["text"])} | own
        docs = self.spark.createDataFrame([row], documents.SCHEMA)
        store = VersionStore(self.spark, f"{self.store_uri}/documents/{time.time_ns():x}")
        done = clean_documents(self.spark, documents.texts(docs), docs, Approvals(all=approve), store)
        with self.lock:
            self.stores[doc_id] = store
        return {"doc_id": doc_id, "entities": rows_of(done.entities), "issues": rows_of(done.issues), "records": rows_of(done.records), "validation": done.validation, "version": store.current()}

    def rollback_document(self, doc_id: str, version: int) -> dict[str, Any]:
        with self.lock:
            store = self.stores.get(doc_id)
            if store is None:
                raise Refused(404, f"no document {doc_id}")
            try:
                now = store.restore(version)
            except KeyError as e:
                raise Refused(404, str(e)) from e
        return {"doc_id": doc_id, "restored": version, "version": now, "entities": rows_of(store.read())}

    def metrics(self) -> str:
        return "".join(f'requests_total{{path="{p}"}} {n}\n' for p, n in sorted(self.served.items()))

    def answer(self, method: str, path: str, header: str | None, body: dict[str, Any]) -> tuple[int, Any]:
        """Status and JSON value, or text, for a request; transport apart."""
        path = path.split("?")[0].rstrip("/") or "/"
        with self.lock:
            self.served[path] = self.served.get(path, 0) + 1
        try:
            match method, path:
                case "GET", "/":
                    return 200, {"service": "rinsework", "paths": ["/healthz", "/metrics", "/api/v1/auth/token", "/api/v1/clean", "/api/v1/provenance", "/api/v1/rollback", "/api/v1/clean-document", "/api/v1/rollback-document"]}
                case "GET", "/healthz":
                    return 200, {"status": "ok", "spark": self.spark.version}
                case "GET", "/metrics":
                    return 200, self.metrics()
                case "POST", "/api/v1/auth/token":
                    return 200, self.token(str(body.get("username", "")), str(body.get("password", "")))
                case "POST", "/api/v1/clean":
                    self.allow(header, "clean")
                    return 200, self.clean(body.get("records") or [], body.get("columns"), body.get("target_loss_limit"), bool(body.get("approve")))
                case "GET", "/api/v1/provenance":
                    self.allow(header, "provenance")
                    return 200, self.provenance()
                case "POST", "/api/v1/rollback":
                    self.allow(header, "rollback")
                    return 200, self.rollback(int(body.get("version", 0)))
                case "POST", "/api/v1/clean-document":
                    self.allow(header, "clean")
                    content = base64.b64decode(body["content"]) if "content" in body else str(body.get("text", "")).encode()
                    return 200, self.clean_document(str(body.get("filename", "")), content, bool(body.get("approve")))
                case "POST", "/api/v1/rollback-document":
                    self.allow(header, "rollback")
                    return 200, self.rollback_document(str(body.get("doc_id", "")), int(body.get("version", 0)))
            raise Refused(404, "no such path")
        except Refused as e:
            return e.status, {"detail": e.why}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("an object is needed")
                status, value = service.answer(self.command, self.path, self.headers.get("Authorization"), body)
            except ValueError as e:
                status, value = 400, {"detail": str(e)}
            raw = value.encode() if isinstance(value, str) else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
