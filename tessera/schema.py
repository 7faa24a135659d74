"""Column types, configuration and errors shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
POLYGON = f"struct<exterior:{LINE},holes:array<{LINE}>>"
MBR = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"

#: Columns of a feature table, before its centroid, rectangle and validity are derived.
RAW_FEATURE = f"id long, id_str string, geom_type string, point {POINT}, line {LINE}, polygon {POLYGON}, properties string"
FEATURE = f"{RAW_FEATURE}, centroid {POINT}, mbr {MBR}, is_valid boolean"

GEOM_TYPES = ("POINT", "LINESTRING", "POLYGON")


class SpatialError(Exception):
    """Base of all errors of this package."""


class InvalidArgument(SpatialError, ValueError):
    """A missing or malformed argument."""


class NotFound(SpatialError, KeyError):
    """No object or index of that name."""


class AlreadyExists(SpatialError):
    """An object or index of that name is there already."""


class ParseError(SpatialError, ValueError):
    """Text that is not GeoJSON or WKT, in strict mode."""


class StorageError(SpatialError, OSError):
    """A saved index that is missing, foreign or damaged."""


@dataclass(frozen=True)
class SpatialConfig:
    """How features are laid out.

    block_size: most features of a block, beside split points; page_capacity: most
    features of a page; pages_per_track: pages that share a track; exact_rows: nodes of
    more rows find their median by counting, those of fewer are split in one task (results do
    not depend on it); strategy: order of pages in a block (zorder or sequential);
    allocation: the track that a new page goes to (nearest, best_fit, sequential or new).
    """

    block_size: int = 1024
    page_capacity: int = 64
    pages_per_track: int = 16
    exact_rows: int = 1_000_000
    strategy: str = "zorder"
    allocation: str = "nearest"
    persist: bool = False
    data_path: str | None = None

    def __post_init__(self):
        if min(self.block_size, self.page_capacity, self.pages_per_track, self.exact_rows) < 1:
            raise InvalidArgument("sizes must be positive")
        if self.strategy not in ("zorder", "sequential"):
            raise InvalidArgument(f"unknown strategy {self.strategy!r}")
        if self.allocation not in ("nearest", "best_fit", "sequential", "new"):
            raise InvalidArgument(f"unknown allocation {self.allocation!r}")
