"""An ASGI application over one profile: index its source, ask it questions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from .operators.store import IncompatibleIndex, MissingIndex
from .plans import answer
from .plans import policy as P

MOST_BYTES = 64 * 1024
_ID = re.compile(r"[A-Za-z0-9._:-]{1,128}")


class Refused(Exception):
    def __init__(self, status: int, code: str):
        super().__init__(code)
        self.status, self.code = status, code


class Service:
    """What the routes do, over a Spark session and a store."""

    def __init__(self, spark, profile: dict, path: str):
        self.spark, self.profile, self.path = spark, profile, path
        self.uri = profile["source"]["uri"]

    def index(self) -> dict:
        return {"chunks": answer.index(self.spark, self.profile, self.path, self.uri)}

    def ask(self, query: str) -> dict:
        chunks = answer.Store(self.spark, self.path).rows(P.manifest(self.uri, self.profile))
        said, found = answer.ask(chunks, self.spark.createDataFrame([(0, query)], "query_id long, query string"), self.profile)
        r = said.first()
        return {"answer": r.answer, "citation": r.citation, "retrieved": [{"rank": f.rank, "uri": f.uri, "chunk_id": f.chunk_id} for f in found.orderBy("rank").collect()]}


async def _body(receive) -> dict:
    raw = b""
    while True:
        m = await receive()
        if m["type"] != "http.request":
            raise Refused(400, "invalid_request")
        raw += m.get("body", b"")
        if len(raw) > MOST_BYTES:
            raise Refused(413, "request_too_large")
        if not m.get("more_body"):
            break
    try:
        body = json.loads(raw)
    except ValueError:
        raise Refused(400, "invalid_json") from None
    if not isinstance(body, dict):
        raise Refused(400, "invalid_schema")
    return body


def create_app(service: Service, ready: Callable[[], bool] = lambda: True, telemetry: P.Telemetry | None = None):
    """Routes: GET /healthz and /readyz, POST /v1/index {source_uri} and /v1/ask {source_uri, query}.

    Only the profile's own source is served; errors are {error: {code}}, never texts of the corpus.
    """
    telemetry = telemetry or P.Telemetry()

    def strings(body: dict, *names: str) -> list[str]:
        if set(body) != set(names) or any(not isinstance(body[n], str) or not body[n].strip() for n in names):
            raise Refused(400, "invalid_schema")
        if body["source_uri"] != service.uri:
            raise Refused(400, "source_not_allowed")
        return [body[n] for n in names]

    async def dispatch(method: str, path: str, receive) -> tuple[int, dict]:
        want = {"/healthz": "GET", "/readyz": "GET", "/v1/index": "POST", "/v1/ask": "POST"}.get(path)
        if want is None:
            raise Refused(404, "not_found")
        if method != want:
            raise Refused(405, "method_not_allowed")
        if path == "/healthz":
            return 200, {"status": "ok"}
        if path == "/readyz":
            return (200, {"status": "ready"}) if ready() else (503, {"status": "not_ready"})
        body = await _body(receive)
        if path == "/v1/index":
            strings(body, "source_uri")
            return 200, service.index()
        return 200, service.ask(strings(body, "source_uri", "query")[1])

    async def app(scope, receive, send) -> None:
        if scope["type"] != "http":
            raise ValueError("only HTTP is served")
        sent = next((v.decode("latin-1") for k, v in scope.get("headers", ()) if k.lower() == b"x-request-id"), "")
        request = sent if _ID.fullmatch(sent) else uuid.uuid4().hex
        with telemetry.stage("http", route=scope["path"] if scope["path"] in ("/healthz", "/readyz", "/v1/index", "/v1/ask") else "unmatched"):
            try:
                status, payload = await dispatch(scope["method"], scope["path"], receive)
            except Refused as e:
                status, payload = e.status, {"error": {"code": e.code}}
            except (IncompatibleIndex, MissingIndex) as e:
                status, payload = 409, {"error": {"code": "incompatible_index" if isinstance(e, IncompatibleIndex) else "missing_index"}}
            except (OverflowError, ValueError):
                status, payload = 400, {"error": {"code": "refused"}}
            except Exception:
                status, payload = 500, {"error": {"code": "internal_error"}}
        raw = json.dumps({"request_id": request, **payload}, ensure_ascii=False).encode()
        await send({"type": "http.response.start", "status": status, "headers": [(b"content-type", b"application/json"), (b"content-length", str(len(raw)).encode()), (b"x-request-id", request.encode())]})
        await send({"type": "http.response.body", "body": raw})

    return app
