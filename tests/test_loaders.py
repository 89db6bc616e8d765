"""Document loaders: headers, redirects and Link headers, against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quadloom.model.errors import LinkedDataError
from quadloom.sources import loaders


class _Handler(BaseHTTPRequestHandler):
    pages = {
        "/doc": (200, {"Content-Type": "application/ld+json"}, '{"a": 1}'), "/json": (200, {"Content-Type": "application/json", "Link": '<ctx>; rel="http://www.w3.org/ns/json-ld#context"'}, '{"b": 1}'),
        "/two": (200, {"Content-Type": "application/json", "Link": '<c1>; rel="http://www.w3.org/ns/json-ld#context", <c2>; rel="http://www.w3.org/ns/json-ld#context"'}, "{}"),
        "/html": (200, {"Content-Type": "text/html", "Link": '<doc>; rel="alternate"; type="application/ld+json"'}, "<p>"), "/moved": (302, {"Location": "/doc"}, ""), "/loop": (302, {"Location": "/loop"}, ""),
        "/gone": (404, {}, ""), "/bad": (200, {"Content-Type": "application/json"}, "{"),
    }

    def do_GET(self):  # noqa: N802
        if self.path == "/echo":
            status, headers, body = 200, {"Content-Type": "application/json"}, json.dumps(dict(self.headers))
        else:
            status, headers, body = self.pages[self.path]
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_documents_and_links(url):
    load = loaders.http()
    assert load(f"{url}/doc") == {"contextUrl": None, "documentUrl": f"{url}/doc", "document": {"a": 1}}
    assert load(f"{url}/json")["contextUrl"] == f"{url}/ctx"
    assert load(f"{url}/html")["documentUrl"] == f"{url}/doc"
    assert load(f"{url}/moved")["document"] == {"a": 1}
    sent = loaders.http(headers={"X-Test": "1"})(f"{url}/echo")["document"]
    assert sent["Accept"] == loaders.ACCEPT and sent["X-Test"] == "1"


@pytest.mark.parametrize(("path", "code"), [("/two", "multiple context link headers"), ("/loop", "recursive context inclusion"), ("/gone", "loading document failed"), ("/bad", "loading document failed")])
def test_errors(url, path, code):
    with pytest.raises(LinkedDataError) as e:
        loaders.http()(url + path)
    assert e.value.code == code


def test_limits(url):
    for load, target in ((loaders.http(secure=True), f"{url}/doc"), (loaders.http(max_redirects=0), f"{url}/moved"), (loaders.http(), "file:///etc/hosts"), (loaders.table([]), "x:y")):
        with pytest.raises(LinkedDataError):
            load(target)
    with pytest.raises(ValueError):
        loaders.build_headers({"Accept": "x"})


def test_link_header():
    links = loaders.parse_link_header('<a>; rel="x"; type="t", <b>; rel=x, <c,d>; rel="y"')
    assert links == {"x": [{"target": "a", "rel": "x", "type": "t"}, {"target": "b", "rel": "x"}], "y": {"target": "c,d", "rel": "y"}}


def test_equal_loads_at_once_are_one():
    calls, go = [], threading.Event()

    def slow(url):
        calls.append(url)
        go.wait(5)
        return {"document": 1}

    queue = loaders.Queue(slow)
    threads = [threading.Thread(target=queue, args=("u",)) for _ in range(4)]
    for t in threads:
        t.start()
    while not calls:
        pass
    threading.Event().wait(0.2)
    go.set()
    for t in threads:
        t.join()
    assert calls == ["u"]
