import json

import pytest

from quorumlake.sources import registry as R

PAGES = {
    "https://x/api/": {"move": "m", "type": "t", "other": "o"}, "https://x/api/move?limit=1025": [1], "https://x/api/type?limit=1025": [2],
    "https://x/api/a.json": [{"a": 1}], "https://x/api/b.json": [{"b": 1}], "https://x/one.json": {"k": 1},
}


class Server:
    """Answers from a table of pages and remembers what it was asked."""

    def __init__(self, tag="v1"):
        self.tag, self.asked, self.broken = tag, [], set()

    def __call__(self, method, url):
        self.asked.append((method, url))
        if url in self.broken or url not in PAGES:
            raise OSError(url)
        return R.Answer({"ETag": f'"{self.tag}"'}, json.dumps(PAGES[url]).encode() if method == "GET" else b"")


def test_one_document_is_loaded_once(tmp_path):
    server = Server()
    c = R.connector("pvpoke")("pvpoke", tmp_path, {"url": "https://x/one.json"}, server)
    first = c.fetch()
    assert json.loads((first / "one.json").read_text()) == {"k": 1} and json.loads((first / ".meta.json").read_text())["etag"] == "v1"
    assert c.fetch() == first and server.asked[-1][0] == "HEAD"
    server.tag = "v2"  # another tag, the same content: the new snapshot goes again
    assert c.fetch() == first and len(c.snapshots()) == 1
    forced = c.fetch(force=True)
    assert forced > first and len(c.snapshots()) == 2
    with pytest.raises(ValueError):
        R.connector("pvpoke")("pvpoke", tmp_path, {}, server).fetch()


def test_endpoints_and_what_fails(tmp_path):
    server = Server()
    config = {"base_url": "https://x/api/", "endpoints": [{"name": "a", "path": "/a.json"}, {"name": "b", "path": "b.json"}], "main": "b"}
    c = R.connector("pogoapi_net")("pogoapi_net", tmp_path, config, server)
    server.broken.add("https://x/api/a.json")
    assert {p.name for p in c.fetch().iterdir()} == {"b.json", ".meta.json"} and c.failed == ["a"]
    server.broken.add("https://x/api/b.json")
    before = c.snapshots()
    with pytest.raises(OSError):
        c.fetch()
    assert c.snapshots() == before


def test_endpoints_found_in_the_index(tmp_path):
    server = Server()
    c = R.connector("pokeapi")("pokeapi", tmp_path, {"base_url": "https://x/api"}, server)
    assert {p.name for p in c.fetch().iterdir()} == {"type.json", "move.json", ".meta.json"}
    server.broken.add("https://x/api/")
    assert list(c.documents()) == []


def test_local_files_and_text(tmp_path):
    a, b = tmp_path / "in/a.json", tmp_path / "in/b.json"
    a.parent.mkdir()
    a.write_text("[1]")
    b.write_text("no json")
    c = R.connector("local_authoring")("local_authoring", tmp_path / "raw", {"files": [str(a), str(b), str(tmp_path / "none.json")]})
    folder = c.fetch()
    assert {p.name for p in folder.iterdir()} == {"a.json", "b", ".meta.json"} and c.failed == ["none"]
    assert c.fetch() == folder


def test_all_enabled_sources(tmp_path):
    config = {"sources": {"pvpoke": {"url": "https://x/one.json"}, "rplus_shiny": {"enabled": False}, "nobody": {}, "pokeapi": {"base_url": "https://x/api"}}}
    found = R.fetch_all(config, tmp_path, opener=Server())
    assert set(found) == {"pvpoke", "nobody", "pokeapi"} and found["pvpoke"].is_dir() and "KeyError" in found["nobody"]
    assert set(R.fetch_all(config, tmp_path, ["pvpoke"], opener=Server())) == {"pvpoke"}
    assert {"pokemon_go_api", "pogoapi_net", "local_authoring"} <= set(R.registered())
