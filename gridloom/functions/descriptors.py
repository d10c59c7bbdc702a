"""The text language for requesting statistics, and the names of result columns.

``[alias=]stat[(values[, weights][, key=value ...])]``. Without raster names a
descriptor applies to every value raster; with them, to the named ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

_HEAD = re.compile(r"(?:(\w+)=)?(\w+)")
_ARGS = re.compile(r"\(([ ,.=\w-]+)\)\Z")


class DescriptorError(ValueError):
    """A descriptor or its arguments can't be understood."""


@dataclass(frozen=True)
class Descriptor:
    """A parsed request for one statistic."""

    stat: str
    name: str = ""
    values: str = ""
    weights: str = ""
    args: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        inside = [x for x in (self.values, self.weights) if x] + [f"{k}={v}" for k, v in self.args.items()]
        return (f"{self.name}=" if self.name else "") + self.stat + (f"({','.join(inside)})" if inside else "")


def parse_descriptor(text: str) -> Descriptor:
    """Parse one descriptor; blanks around arguments don't count."""
    if not text:
        raise DescriptorError("Invalid stat descriptor. Descriptor is empty.")
    head = _HEAD.match(text)
    if not head:
        raise DescriptorError("Invalid stat descriptor. No stat name found.")
    rest, rasters, args = text[head.end() :], [], {}
    inside = _ARGS.match(rest)
    if rest and not inside:
        raise DescriptorError(f"Invalid stat descriptor. Failed to parse: {rest}")
    for item in inside[1].split(",") if inside else []:
        item = item.strip()
        pieces = [p.strip() for p in item.split("=")]
        if not item:
            raise DescriptorError("Invalid stat descriptor. Empty argument.")
        if len(pieces) > 2:
            raise DescriptorError(f"Invalid stat descriptor. Malformed keyword argument: {item}")
        if len(pieces) == 2:
            if pieces[0] in args:
                raise DescriptorError(f"Invalid stat descriptor. Argument {pieces[0]} specified multiple times.")
            args[pieces[0]] = pieces[1]
        elif args:
            raise DescriptorError("Invalid stat descriptor. Raster name provided after keyword arguments.")
        elif len(rasters) == 2:
            raise DescriptorError("Invalid stat descriptor. Expected keyword argument.")
        else:
            rasters.append(item)
    values, weights = (*rasters, "", "")[:2]
    return Descriptor(head[2], head[1] or "", values, weights, args)


def parse_dataset(text: str) -> tuple[str, str]:
    """``file[layer]`` -> file, layer (``"0"`` by default)."""
    m = re.fullmatch(r"(.*)\[([^\[\]]*)\]", text, re.S)
    return (m[1], m[2]) if m else (text, "0")


def parse_raster(text: str) -> tuple[str, str, int]:
    """``name:file[band]`` -> name, file, band (0: all bands); a ``[`` before the ``:`` belongs to the name."""
    name, colon, file = text.partition(":")
    if not colon:
        name, file = "", text
    m = re.fullmatch(r"(.*)\[(\d+)\]", file, re.S)
    file, band = (m[1], int(m[2])) if m else (file, 0)
    if not file:
        raise DescriptorError(f"No file in raster descriptor: {text}")
    return name, file, band


def band_names(root: str, n_bands: int, single: bool = False) -> list[str]:
    """Names of the bands of a raster: ``root``, ``root_band_i``, ``band_i`` or an empty one."""
    if n_bands == 1 or single:
        return [root]
    return [f"{root}_band_{i}" if root else f"band_{i}" for i in range(1, n_bands + 1)]


def unique_raster_names(names: list[str]) -> None:
    """Refuse repeated raster names."""
    seen = set()
    for n in names:
        if n in seen:
            raise DescriptorError(f"Duplicated raster name: {n}")
        seen.add(n)


#: Least and greatest value of the integer cell types.
INTEGER_RANGE = {f"{u}int{b}": ((0 if u else -(1 << b - 1)), ((1 << b) if u else (1 << b - 1)) - 1) for u in ("", "u") for b in (8, 16, 32, 64)}


def parse_literal(text: str, dtype: str):
    """A literal of a cell type (``bool``, ``float32``, ``float64`` or an integer type), with range check."""
    bad = DescriptorError(f"Failed to parse value: {text}")
    if dtype == "bool":
        got = {"yes": True, "true": True, "no": False, "false": False}.get(text.lower())
        if got is None:
            raise bad
        return got
    if dtype in ("float32", "float64"):
        try:
            return float(text)
        except ValueError:
            raise bad from None
    try:
        number = Decimal(text)
    except InvalidOperation:
        raise bad from None
    if not number.is_finite() or number != number.to_integral_value():
        raise bad
    low, high = INTEGER_RANGE[dtype]
    if not low <= number <= high:
        raise DescriptorError("Value out of range")
    return int(number)


@dataclass(frozen=True)
class Request:
    """One result column: a statistic of one value raster, perhaps with a weight raster.

    Rasters go by name, or are rasters themselves.
    """

    stat: str
    name: str
    values: object
    weights: object = None
    args: dict[str, str] = field(default_factory=dict)


def _is_weighted(stat: str) -> bool:
    return stat.startswith("weight")


def expand(descriptors: list[str | Descriptor | Request], values: list[str], weights: list[str]) -> list[Request]:
    """Bind descriptors to rasters and name the result columns."""
    out: list[Request] = []
    if descriptors and not values and not all(isinstance(d, Request) for d in descriptors):
        raise DescriptorError("No rasters provided.")
    full = len(values) > 1 or len(weights) > 1
    for d in descriptors:
        if isinstance(d, Request):
            out.append(d)
            continue
        d = parse_descriptor(d) if isinstance(d, str) else d
        if d.values:
            for raster, known in ((d.values, values), (d.weights, [*values, *weights])):
                if raster and raster not in known:
                    raise DescriptorError(f"Unknown raster {raster} in stat {d.stat}")
            pairs, names = [(d.values, d.weights or None)], [f"{d.values}_{d.stat}"]
        else:
            n_weights = len(weights) if d.stat.startswith("weighted") else min(len(weights), 1)
            if len(values) > 1 and n_weights > 1 and len(values) != n_weights:
                raise DescriptorError("Value and weight rasters must have a single band or the same number of bands.")
            pairs = [(values[i % len(values)], weights[i % len(weights)] if weights else None) for i in range(max(len(values), n_weights))]
            named = lambda v, w: f"{v}_{w}_{d.stat}" if d.stat.startswith("weighted") else f"{v}_{d.stat}"
            names = [named(v, w) if full else d.stat for v, w in pairs]
        for (v, w), name in zip(pairs, names, strict=True):
            if w is None and _is_weighted(d.stat):
                raise DescriptorError(f"No weights specified for stat: {d.stat}")
            out.append(Request(d.stat, d.name or name, v, w, dict(d.args)))
    return out


def unique_names(names: list[str]) -> None:
    """Refuse repeated result columns."""
    seen = set()
    for n in names:
        if n in seen:
            raise DescriptorError(f"Operation name is not unique: {n}")
        seen.add(n)
