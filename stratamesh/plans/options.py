"""Options and named constants of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RegionGrowingOptions:
    """Degrees from the seed's normal, distance from its centroid, curvature in degrees, least region size."""

    max_angle: float = 15.0
    max_distance: float = 0.5
    max_curvature: float = 0.35
    min_region_size: int = 3


@dataclass(frozen=True)
class TopologyMergeOptions:
    """Least touching pairs, least boundary triangles, whether supported regions merge, and up to which gap, largest angle."""

    min_touch_area: int = 2
    min_boundary: int = 1
    merge_support: bool = True
    support_gap: float = 1.0
    max_merge_angle: float = 25.0


@dataclass(frozen=True)
class MeshLoadOptions:
    """Budgets of a tile walk; ``max_tiles`` counts meshes, and tiles are the unit, so budgets may be overshot."""

    max_tiles: int | None = None
    max_triangles: int | None = None
    max_depth: int | None = None


@dataclass(frozen=True)
class EngineOptions:
    """``exact_ids``: grow regions, which decide the numbers of entities; without it they follow the first triangles. ``compat``: leave mesh transforms out of extraction."""

    chunk_size: int = 200_000
    cache_capacity: int = 64
    exact_ids: bool = True
    compat: bool = False
    regions: RegionGrowingOptions = field(default_factory=RegionGrowingOptions)
    topology: TopologyMergeOptions = field(default_factory=TopologyMergeOptions)


# Fixed values of the relation tests.
ADJACENT_GAP = (-0.1, 0.5)
SUPPORT_GAP = (-0.5, 1.5)
SUPPORT_RADIUS = 2.0
CROSS_CHUNK_PAD = 0.5
CROSS_CHUNK_CELL = 1.0
EPSILON = 1e-12
UP_FACING = 0.7
WALL_FACING = 0.3
GROUND_AREA = 50.0
#: Weights of relations.
WEIGHTS = {"touch": 1.0, "intersect": 0.5, "contain": 1.0, "adjacent": 0.7, "support": 0.8}
# Colours of labels, as red, green, blue, alpha.
COLORS = {
    "ground": (0.3, 0.7, 0.3, 1.0),
    "wall": (0.8, 0.5, 0.2, 1.0),
    "roof": (0.8, 0.2, 0.2, 1.0),
    "ceiling": (0.5, 0.5, 0.8, 1.0),
}
DEFAULT_COLOR = (0.2, 0.8, 1.0, 1.0)
