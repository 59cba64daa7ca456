"""Connectors by name: they bring a source's documents into snapshot folders.

The network is behind an opener, a function (method, url) -> Answer, so that a connector can be run
against anything; `web` is the usual one. A connector only says which documents a source has and which
one tells whether the source has changed; everything else is common to all.
"""

from __future__ import annotations

import hashlib
import json
import shutil
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Answer:
    """What a server says: headers and the body."""

    headers: Mapping[str, str] = field(default_factory=dict)
    body: bytes = b""


Opener = Callable[[str, str], Answer]


def web(method: str, url: str, timeout: float = 60) -> Answer:
    """The answer of a web server; an error status raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, method=method), timeout=timeout) as r:
        return Answer(dict(r.headers.items()), r.read() if method == "GET" else b"")


def remote_tag(headers: Mapping[str, str]) -> str | None:
    """What tells versions of a remote file apart: its ETag, else its date, else the request's id."""
    low = {k.lower(): v.strip('"') for k, v in headers.items() if v}
    return next((low[k] for k in ("etag", "last-modified", "x-github-request-id") if low.get(k)), None)


def is_unchanged(headers: Mapping[str, str], stored: str | None, force: bool = False) -> bool:
    """Whether a download can be skipped."""
    tag = remote_tag(headers)
    return not force and tag is not None and tag == stored


def content_hash(folder: Path) -> str:
    """SHA-256 over the sorted names and contents of a folder's files, .meta.json left out."""
    out = hashlib.sha256()
    for p in sorted(x for x in folder.iterdir() if x.is_file() and x.name != ".meta.json"):
        out.update(f"{p.name}:{hashlib.sha256(p.read_bytes()).hexdigest()}\n".encode())
    return out.hexdigest()


class Connector:
    """Brings one source's documents into <root>/<source>/<instant>/."""

    def __init__(self, source: str, root: str | Path, config: Mapping[str, Any] | None = None, opener: Opener = web) -> None:
        self.source, self.root, self.config, self.opener = source, Path(root), config or {}, opener
        self.failed: list[str] = []  # documents of the last fetch that couldn't be loaded

    def documents(self) -> dict[str, str]:
        """Name -> address of the source's documents; the first one stands for the source in freshness checks."""
        raise NotImplementedError

    def load(self, address: str) -> Answer:
        return self.opener("GET", address)

    def head(self, address: str) -> Mapping[str, str]:
        return self.opener("HEAD", address).headers

    def snapshots(self) -> list[Path]:
        folder = self.root / self.source
        return sorted(p for p in folder.iterdir() if p.is_dir()) if folder.is_dir() else []

    def new_snapshot(self, now: datetime | None = None) -> Path:
        """A new folder named by the instant, so that names sort by time; a later second if it is taken."""
        now = now or datetime.now(UTC)
        while (folder := self.root / self.source / now.strftime("%Y-%m-%dT%H%M%SZ")).exists():
            now += timedelta(seconds=1)
        folder.mkdir(parents=True)
        return folder

    def write_meta(self, folder: Path, etag: str | None) -> None:
        meta = {"source": self.source, "etag": etag, "timestamp": datetime.now(UTC).isoformat()}
        (folder / ".meta.json").write_text(json.dumps(meta), "utf-8")

    def save_raw(self, folder: Path, name: str, body: bytes) -> Path:
        """A document as delivered: `<name>.json` if it is JSON, else `<name>`."""
        try:
            json.loads(body)
            path = folder / f"{name}.json"
        except ValueError:
            path = folder / name
        path.write_bytes(body)
        return path

    def stored_etag(self) -> str | None:
        """The etag of the last snapshot that has one."""
        for folder in reversed(self.snapshots()):
            meta = folder / ".meta.json"
            if meta.is_file() and (etag := json.loads(meta.read_text("utf-8")).get("etag")):
                return etag
        return None

    def finalised(self, folder: Path, etag: str | None, force: bool = False) -> Path:
        """The snapshot that is current: the new one, or the one before if all contents are the same (the
        new one is removed then, unless forced)."""
        self.write_meta(folder, etag)
        before = [p for p in self.snapshots() if p != folder]
        if not force and before and content_hash(before[-1]) == content_hash(folder):
            shutil.rmtree(folder)
            return before[-1]
        return folder

    def fetch(self, force: bool = False) -> Path:
        """The folder of the snapshot that is current afterwards.

        Nothing is loaded if the source's first document has the stored tag. A document that can't be
        loaded is left out and named in `failed`; if none can be, that is an error and no snapshot stays.
        """
        documents = self.documents()
        first = next(iter(documents), None)
        latest = self.snapshots()
        if first is not None and latest and not force:
            try:
                if is_unchanged(self.head(documents[first]), self.stored_etag()):
                    return latest[-1]
            except OSError:
                pass  # a server that doesn't answer HEAD is asked for the document
        folder, tag, self.failed = self.new_snapshot(), None, []
        for name, address in documents.items():
            try:
                answer = self.load(address)
            except OSError:
                self.failed.append(name)
                continue
            self.save_raw(folder, name, answer.body)
            if name == first:
                tag = remote_tag(answer.headers)
        if documents and len(self.failed) == len(documents):
            shutil.rmtree(folder)
            raise OSError(f"no document of {self.source} could be loaded")
        return self.finalised(folder, tag, force)


_CONNECTORS: dict[str, type[Connector]] = {}


def register(name: str) -> Callable[[type[Connector]], type[Connector]]:
    """Class decorator: makes a connector known by name."""

    def add(cls: type[Connector]) -> type[Connector]:
        _CONNECTORS[name] = cls
        return cls

    return add


def connector(name: str) -> type[Connector]:
    if name not in _CONNECTORS:
        raise KeyError(f"no connector {name!r}; known: {', '.join(sorted(_CONNECTORS)) or 'none'}")
    return _CONNECTORS[name]


def registered() -> list[str]:
    return sorted(_CONNECTORS)


# ---- the kinds of source ------------------------------------------------------------------------


class OneDocument(Connector):
    """A source that is one file: `url`, stored under `document` (by default the file's own name)."""

    def documents(self) -> dict[str, str]:
        url = self.config.get("url")
        if not url:
            raise ValueError(f"source {self.source} has no url")
        return {self.config.get("document") or Path(url.split("?")[0]).stem: url}


class Endpoints(Connector):
    """A source of several endpoints (name, path) under a `base_url`; `main` names the one for freshness checks.

    Without endpoints the base address is asked for its index, an object of resource names, and the
    `resources` of the configuration that it has are loaded up to `page_limit` entries each.
    """

    def documents(self) -> dict[str, str]:
        base = self.config["base_url"].rstrip("/")
        listed = self.config.get("endpoints") or list(self.discovered(base))
        main = self.config.get("main")
        ordered = sorted(listed, key=lambda e: e["name"] != main)
        return {e["name"]: f"{base}/{e['path'].lstrip('/')}" for e in ordered}

    def discovered(self, base: str) -> Iterator[dict[str, str]]:
        try:
            index = json.loads(self.load(f"{base}/").body)
        except (OSError, ValueError):
            return
        for resource in self.config.get("resources", RESOURCES):
            if isinstance(index, dict) and resource in index:
                yield {"name": resource.replace("-", "_"), "path": f"{resource}?limit={self.config.get('page_limit', PAGE_LIMIT)}"}


class LocalFiles(Connector):
    """A source of files on disk (`files`); those that aren't there are left out."""

    def documents(self) -> dict[str, str]:
        return {Path(f).stem: str(f) for f in self.config.get("files", [])}

    def load(self, address: str) -> Answer:
        return Answer({}, Path(address).read_bytes())

    def head(self, address: str) -> Mapping[str, str]:
        return {}


#: Fixed: resources looked for in an index, and how many entries of each are asked for.
RESOURCES, PAGE_LIMIT = ("pokemon", "pokemon-species", "type", "move"), 1025
#: Fixed: the kind of each source, and the name under which a single file is stored.
for _name in ("alexelgt_game_masters", "game_master", "pvpoke", "rplus_shiny"):
    register(_name)(OneDocument)
for _name in ("pokemon_go_api", "pogoapi_net", "pokeapi"):
    register(_name)(Endpoints)
register("local_authoring")(LocalFiles)


def fetch_all(config: Mapping[str, Any], root: str | Path, only: list[str] | None = None, force: bool = False, opener: Opener = web) -> dict[str, Path | str]:
    """The current snapshot of every enabled source of a registry, or what went wrong with it."""
    from quorumlake.sources.templates import enabled_sources

    out: dict[str, Path | str] = {}
    for name, source in enabled_sources(config).items():
        if only and name not in only:
            continue
        try:
            out[name] = connector(name)(name, root, source, opener).fetch(force)
        except (OSError, ValueError, KeyError) as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out
