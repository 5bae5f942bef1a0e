"""Settings from a TOML file, with the rules that keep a run meaningful."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

SECTIONS = ("corpus", "model", "projection", "validation", "artifacts", "viewer")


class SettingsError(RuntimeError):
    """The settings contradict what the pipeline guarantees."""


@dataclass(frozen=True)
class Settings:
    root: Path
    values: dict

    def __getitem__(self, section: str) -> dict:
        return self.values[section]


def find_root(start: Path) -> Path:
    for folder in (start := start.resolve(), *start.parents):
        if (folder / "config.toml").exists():
            return folder
    raise SettingsError(f"no config.toml in or above {start}")


def check(values: dict) -> None:
    if values.get("schema_version") != 1:
        raise SettingsError("schema_version has to be 1")
    if missing := [s for s in SECTIONS if s not in values]:
        raise SettingsError(f"sections are missing: {', '.join(missing)}")
    p = values["projection"]
    if p.get("umap_densmap"):
        raise SettingsError("umap_densmap has to be false: new vectors could not be placed")
    if p.get("l2_normalize") and p.get("umap_metric") == "cosine":
        raise SettingsError("on normalised vectors the metric has to be euclidean")
    if p.get("umap_n_components") != 3:
        raise SettingsError("umap_n_components has to be 3")
    if not values["corpus"].get("label_field"):
        raise SettingsError("corpus.label_field is not set")


def load(start: str | Path = ".") -> Settings:
    root = find_root(Path(start))
    with open(root / "config.toml", "rb") as f:
        values = tomllib.load(f)
    check(values)
    return Settings(root, values)
