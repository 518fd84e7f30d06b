"""Rule inputs: read once on the driver, compiled to Columns by the operators."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.durations import timeout_seconds
from .functions.regex import translate
from .operators.predicates import check_predicate

try:
    import yaml
except ImportError:  # rule files then have to be given as dicts
    yaml = None


@dataclass(frozen=True)
class MatchPoint:
    """A predicate, the extractions ``(field, regex)`` it enables, and a reason template."""

    where: object
    extract: tuple[tuple[str, str], ...] = ()
    reason: str | None = None


@dataclass(frozen=True)
class RegionRule:
    name: str
    start_points: tuple[MatchPoint, ...]
    end_points: tuple[MatchPoint, ...]
    correlate: tuple[str, ...] = ()
    name_template: str = ""
    description_template: str | None = None
    timeout: int | None = None
    timeout_reason: str | None = None
    description: str | None = None
    oldest_first: bool = False


@dataclass(frozen=True)
class ParserRule:
    name: str
    pattern: str
    timestamp_format: str | None = None


def _load(source) -> dict:
    if isinstance(source, dict):
        return source
    if yaml is None:
        raise RuntimeError("reading YAML rules needs the yaml module; give a dict instead")
    path = Path(str(source))
    text = path.read_text() if "\n" not in str(source) and path.is_file() else str(source)
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"bad YAML: {e}") from e
    if not isinstance(data, dict):
        raise ValueError("a rule file must be a mapping")
    return data


def _point(raw: dict) -> MatchPoint:
    if "filter" in raw:
        where = raw["filter"]
    else:  # the richer form: all of include, none of exclude
        where = {"all": list(raw["include"]) + [{"not": x} for x in raw.get("exclude", [])]}
    extract = [("message", raw["regex"])] if raw.get("regex") else []
    extract += [(e["field"], e["regex"]) for e in raw.get("extract", [])]
    for _, pattern in extract:
        translate(pattern)
    return MatchPoint(where, tuple(extract), raw.get("reason"))


def region_rules(source, default_timeout_reason: bool = False) -> list[RegionRule]:
    """Region rules of a YAML text, file or dict; ValueError when one is bad."""
    out = []
    try:
        for raw in _load(source)["regions"]:
            reason = raw.get("timeout_reason")
            if reason is None and default_timeout_reason and raw.get("timeout"):
                reason = f"timeout after {raw['timeout']}"
            out.append(
                RegionRule(
                    name=raw["name"],
                    description=raw.get("description"),
                    start_points=tuple(_point(p) for p in raw["start_points"]),
                    end_points=tuple(_point(p) for p in raw["end_points"]),
                    correlate=tuple(raw["correlate"]),
                    name_template=raw["template"]["name"],
                    description_template=raw["template"].get("description"),
                    timeout=timeout_seconds(raw["timeout"]) if raw.get("timeout") else None,
                    timeout_reason=reason,
                    oldest_first=raw.get("pairing") == "oldest",
                )
            )
    except (KeyError, TypeError) as e:
        raise ValueError(f"bad region rule: {e!r}") from e
    return out


def region_rules_from_dirs(dirs: list[str]) -> list[RegionRule]:
    """Rules of all YAML files, folder by folder, in file-name order; a bad file warns and is skipped."""
    out: list[RegionRule] = []
    for folder in dirs:
        for path in _yaml_files(folder):
            try:
                out += region_rules(path)
            except (ValueError, OSError) as e:
                warnings.warn(f"region rules {path} skipped: {e}", stacklevel=2)
    return out


def category_rules(spark: SparkSession, source) -> list[tuple[str, object]]:
    """``(name, predicate)`` in file order; a bad predicate warns and is skipped."""
    out = []
    for raw in _load(source)["categories"]:
        try:
            check_predicate(spark, raw["filter"])
            out.append((raw["name"], raw["filter"]))
        except ValueError as e:
            warnings.warn(f"category {raw.get('name')!r} skipped: {e}", stacklevel=2)
    return out


def category_rules_from_dirs(spark: SparkSession, dirs: list[str]) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for folder in dirs:
        for path in _yaml_files(folder):
            try:
                out += category_rules(spark, path)
            except (ValueError, KeyError, OSError) as e:
                warnings.warn(f"category rules {path} skipped: {e}", stacklevel=2)
    return out


def parser_rules(source) -> dict[str, list[ParserRule]]:
    """Parser groups by name; a bad regex is an error."""
    groups: dict[str, list[ParserRule]] = {}
    try:
        for group in _load(source)["groups"]:
            rules = [ParserRule(p["name"], p["pattern"], p.get("timestamp_format")) for p in group["parsers"]]
            for r in rules:
                try:
                    translate(r.pattern)
                except ValueError as e:
                    raise ValueError(f"parser {r.name!r} of group {group['name']!r}: {e}") from e
            groups[group["name"]] = rules
    except (KeyError, TypeError) as e:
        raise ValueError(f"bad parser rule: {e!r}") from e
    return groups


def _yaml_files(folder: str) -> list[Path]:
    root = Path(folder)
    return sorted(p for p in root.iterdir() if p.suffix in (".yaml", ".yml")) if root.is_dir() else []
