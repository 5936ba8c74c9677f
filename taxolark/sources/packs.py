"""Domain packs: a domain's field mapping, schema and rules in YAML, compiled to what the operators take."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taxolark.operators import mapping, quality

REQUIRED = ("title", "description", "language")
VERSION = re.compile(r"^\d{4}\.\d{2}(-[a-z0-9]+)?$")
TYPES = {"categorical": T.StringType(), "text": T.StringType(), "numeric": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


class PackError(ValueError):
    pass


@dataclass(frozen=True)
class Pack:
    domain: str
    taxonomy_version: str
    input_mapping: dict[str, list[str]]
    output_schema: dict[str, Any]
    attribute_hints: dict[str, Any] = field(default_factory=dict)
    rules: dict[str, Any] = field(default_factory=dict)
    prompts: dict[str, str] = field(default_factory=dict)
    runtime: dict[str, Any] = field(default_factory=dict)

    def attributes(self) -> list[quality.Attribute]:
        """The expected attributes, each with its hints laid over it."""
        out = []
        for a in self.output_schema["attributes"]:
            a = a | self.attribute_hints.get(a["key"], {})
            out.append(quality.Attribute(a["key"], a.get("type", "text"), bool(a.get("required")), tuple(a.get("allow_values", ())), a.get("pattern"), a.get("max_length")))
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(a.key, TYPES[a.kind]) for a in self.attributes()])

    def adapt(self, df: DataFrame, source: str, uri: str | None = None) -> DataFrame:
        return mapping.adapt(df, self.input_mapping, source, self.rules.get("normalize_map"), self.rules.get("blocked_terms", ()), uri)


def problems(data: dict[str, Any]) -> list[str]:
    out = []
    for key in ("domain", "taxonomy_version", "input_mapping", "output_schema"):
        if not data.get(key):
            out.append(f"{key} is missing")
    if out:
        return out
    if not VERSION.match(str(data["taxonomy_version"])):
        out.append("taxonomy_version must look like 2024.01")
    out += [f"input_mapping has no {k}" for k in REQUIRED if k not in data["input_mapping"]]
    schema = data["output_schema"]
    out += [f"output_schema has no {k}" for k in ("core_item", "attributes") if k not in schema]
    keys = [a.get("key") for a in schema.get("attributes", [])]
    out += [f"hints for unknown attribute {k}" for k in data.get("attribute_hints") or {} if k not in keys]
    for a in schema.get("attributes", []):
        if a.get("type", "text") not in TYPES:
            out.append(f"attribute {a.get('key')} has an unknown type")
        if a.get("type") == "categorical" and not (a.get("allow_values") or ((data.get("attribute_hints") or {}).get(a.get("key")) or {}).get("allow_values")):
            out.append(f"categorical attribute {a.get('key')} has no values")
    return out


def pack(data: dict[str, Any]) -> Pack:
    if wrong := problems(data):
        raise PackError("; ".join(wrong))
    listed = {k: [v] if isinstance(v, str) else list(v) for k, v in data["input_mapping"].items()}
    known = {k: data[k] for k in ("domain", "output_schema", "attribute_hints", "rules", "prompts", "runtime") if data.get(k) is not None}
    return Pack(**known, taxonomy_version=str(data["taxonomy_version"]), input_mapping=listed)


class Loader:
    """Packs by path, the last so many kept."""

    def __init__(self, keep: int = 128):
        self.keep, self.kept = keep, OrderedDict()

    def load(self, path: str | Path) -> Pack:
        import yaml

        path = Path(path)
        if path not in self.kept:
            self.kept[path] = pack(yaml.safe_load(path.read_text(encoding="utf-8")))
            while len(self.kept) > self.keep:
                self.kept.popitem(last=False)
        self.kept.move_to_end(path)
        return self.kept[path]

    def load_directory(self, directory: str | Path) -> Pack:
        for name in ("domain.yaml", "domain.yml"):
            if (path := Path(directory) / name).exists():
                return self.load(path)
        raise PackError(f"no domain file in {directory}")

    def reload(self, path: str | Path) -> Pack:
        self.kept.pop(Path(path), None)
        return self.load(path)

    def clear(self) -> None:
        self.kept.clear()

    def cached(self) -> list[str]:
        return [str(p) for p in self.kept]


def scan(base: str | Path) -> list[str]:
    """Paths of all domain files below a folder."""
    return sorted(str(p) for n in ("domain.yaml", "domain.yml") for p in Path(base).rglob(n))


def merge(core: dict[str, dict], domain: dict[str, dict], strategy: str = "domain_wins") -> dict[str, dict]:
    """Attribute definitions of two schemas by key: domain_wins, core_wins, strict (an error if they differ), or merge."""
    out = dict(core)
    for key, own in domain.items():
        if key not in core or strategy == "domain_wins":
            out[key] = own
        elif strategy == "strict":
            differ = [k for k in set(core[key]) & set(own) if core[key][k] != own[k]]
            if differ:
                raise PackError(f"{key}: {', '.join(sorted(differ))} differ")
            out[key] = core[key] | own
        elif strategy == "merge":
            both = core[key] | own
            for k in ("allow_values", "examples"):
                if k in core[key] and k in own:
                    both[k] = list(dict.fromkeys([*core[key][k], *own[k]]))
            out[key] = both
        elif strategy != "core_wins":
            raise PackError(f"strategy {strategy!r} is unknown")
    return out


def export(schema: dict[str, Any], form: str = "json") -> str:
    if form == "json":
        return json.dumps(schema, indent=2, ensure_ascii=False, sort_keys=True)
    import yaml

    return yaml.safe_dump(schema, allow_unicode=True, sort_keys=True)
