"""The state of a view as a URL fragment, in two forms of links.

A form is a table: for each key how its text becomes a part of the state, and how
the state becomes texts.  A key that ends in a dot stands for all that begin with
it.  What makes no sense is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import parse_qsl, urlencode


class Part(NamedTuple):
    decode: Callable[[str, str], dict]
    encode: Callable[[dict], dict[str, str]]


def _numbers(text: str, n: int) -> list[float]:
    found = [float(x) for x in text.split(",")]
    if len(found) != n or not all(map(math.isfinite, found)):
        raise ValueError(text)
    return found


def _shown(name: str, key: str) -> Callable[[dict], dict[str, str]]:
    """A value as it is, unless it is empty or less than nothing."""
    return lambda state: {key: str(v)} if (v := state.get(name)) not in (None, "") and v != -1 else {}


def _index(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(text)
    return int(text)


def _codes(text: str) -> dict[str, int]:
    """Facets with codes from 0, ``name:code`` joined by commas."""
    pairs = [x.split(":") for x in text.split(",")]
    return {x[0]: int(x[1]) for x in pairs if len(x) == 2 and x[0] and x[1].isdigit()}


_QUERY = Part(lambda _, text: {"query": text}, _shown("query", "q"))

#: Links of this package: a camera of six numbers, and the filters' values by name.
NAMED = {
    "cam": Part(lambda _, text: {"camera": _numbers(text, 6)}, lambda s: {"cam": ",".join(f"{x:.2f}" for x in s["camera"])} if s.get("camera") else {}),
    "sel": Part(lambda _, text: {"selected": _index(text)}, _shown("selected", "sel")),
    "q": _QUERY,
    "f.": Part(lambda name, text: {"filters": {name: text}} if text else {}, lambda s: {f"f.{k}": v for k, v in sorted(s.get("filters", {}).items()) if v}),
}

#: Links with the codes that artefacts give to values.  Fixed values: the keys c, s, q and f, and three numbers each of camera and target.
CODED = {
    "c": Part(lambda _, text: dict(zip(("camera", "target"), (_numbers(text, 6)[:3], _numbers(text, 6)[3:]), strict=True)), lambda s: {"c": ",".join(f"{round(x, 2):g}" for x in [*s["camera"], *s["target"]])} if s.get("camera") and s.get("target") else {}),
    "s": Part(lambda _, text: {"selected": _index(text)}, _shown("selected", "s")),
    "q": _QUERY,
    "f": Part(lambda _, text: {"filters": _codes(text)}, lambda s: {"f": ",".join(f"{k}:{v}" for k, v in s.get("filters", {}).items() if v >= 0)}),
}


def read(fragment: str, form: dict[str, Part] = NAMED) -> dict:
    """camera, selected (an index), query, filters, and in coded links target; what is not there is null or empty."""
    state: dict = {"camera": None, "selected": None, "query": "", "filters": {}}
    for key, text in parse_qsl(fragment.lstrip("#?"), keep_blank_values=True):
        head, dot, name = key.partition(".")
        try:
            found = form[head + dot].decode(name, text)
        except (KeyError, ValueError):
            continue
        state |= found | {"filters": state["filters"] | found.get("filters", {})}
    return state


def write(state: dict, form: dict[str, Part] = NAMED) -> str:
    """The fragment of a state; numbers have two decimals at most and empty parts are left out."""
    return urlencode([(k, v) for part in form.values() for k, v in part.encode(state).items() if v], safe=",")
