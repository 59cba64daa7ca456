"""Declarative templates: how records and claims come out of a source's documents."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from quorumlake.functions.transforms import compiled

MODES = ("top_level_list", "dict_of_lists", "list_of_dicts_with_subkey", "single_object", "dict_of_scalars")

#: Fixed: trust of sources, 1 is the most trusted; what isn't listed has rank 99.
TRUST = {
    "confirmed_owner_submission": 1,
    "local_authoring": 1,
    "authoritative_game_master": 2,
    "alexelgt_game_masters": 2,
    "rplus_shiny": 3,
    "pokemon_go_api": 4,
    "pvpoke": 5,
    "pogoapi_net": 6,
    "pokeapi": 7,
    "unverified_claim": 8,
}
UNLISTED = 99


@dataclass(frozen=True)
class SubRecords:
    """A nested list or object whose members are entities of their own."""

    list_field: str
    container_type: str = "list"
    field_mappings: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    gender_signals: list[Mapping[str, Any]] = field(default_factory=list)


@dataclass(frozen=True)
class Template:
    """One endpoint of one source. Mappings include the overrides, which beat them."""

    source_key: str
    endpoint: str
    mode: str
    unwrap_path: list[str] = field(default_factory=list)
    key_becomes_field: str | None = None
    dict_key_field: str = "key"
    dict_value_field: str = "value"
    identity_field: str | None = None
    entity_id_prefix: str | None = None
    field_mappings: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    gender_signals: list[Mapping[str, Any]] = field(default_factory=list)
    sub_records: list[SubRecords] = field(default_factory=list)

    @property
    def prefix(self) -> str:
        return self.entity_id_prefix or self.source_key

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        for group in (self.field_mappings, *[s.field_mappings for s in self.sub_records]):
            for mapping in group.values():
                compiled(mapping)


def template_from(data: Mapping[str, Any]) -> Template:
    """A template from its parsed YAML or JSON; keys the engine doesn't use are ignored."""
    how = data.get("record_extraction") or {}
    subs = [
        SubRecords(s["list_field"], s.get("container_type", "list"), s.get("field_mappings") or {}, s.get("gender_signals") or [])
        for s in data.get("sub_records") or []
    ]
    return Template(
        source_key=data["source_key"],
        endpoint=data["endpoint"],
        mode=how.get("iterate_mode", "top_level_list"),
        unwrap_path=list(how.get("unwrap_path") or []),
        key_becomes_field=how.get("key_becomes_field"),
        dict_key_field=how.get("dict_key_field") or "key",
        dict_value_field=how.get("dict_value_field") or "value",
        identity_field=data.get("identity_field"),
        entity_id_prefix=data.get("entity_id_prefix"),
        field_mappings={**(data.get("field_mappings") or {}), **(data.get("overrides") or {})},
        gender_signals=data.get("gender_signals") or [],
        sub_records=subs,
    )


def parse_config(text: str) -> Any:
    """YAML if the library is installed, else JSON (which is YAML too)."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def load_templates(folder: str | Path) -> dict[str, Template]:
    """All templates of a folder by `source_key/endpoint`, found by what they say, not by file name."""
    out = {}
    for p in sorted(Path(folder).glob("*.yml")):
        t = template_from(parse_config(p.read_text("utf-8")))
        out[f"{t.source_key}/{t.endpoint}"] = t
    return out


def enabled_sources(config: Mapping[str, Any]) -> dict[str, Mapping[str, Any]]:
    """The sources of a registry that aren't switched off."""
    return {k: s for k, s in (config.get("sources") or {}).items() if s.get("enabled", True)}
