"""Parameters of cameras and of the segmentation pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Camera:
    """A pinhole camera; depth times z_slope is metres."""

    cx: float = 318.39
    cy: float = 271.99
    focal: float = 528.01
    z_slope: float = 0.001


@dataclass(frozen=True)
class Parameters:
    """What one run of the segmentation needs. count > 0 sets the number of clusters, else base_radius (metres) rules."""

    camera: Camera = field(default_factory=Camera)
    weight_color: float = 2.0
    weight_spatial: float = 1.0
    weight_normal: float = 3.0
    weight_depth: float = 0.0
    iterations: int = 5
    coverage: float = 1.7
    base_radius: float = 0.024
    count: int = 0
    color_space: str = "RGB"
    seed_mode: str = "rect"
    metric: str = "rgbd"
    density_mode: str = "depth"
    gradient_adaptive_density: bool = True
    is_conquer_enclaves: bool = True
    is_improve_seeds: bool = False
    is_repair_depth: bool = False
    is_smooth_depth: bool = False
    segment_threshold: float = 1.0
    seed: int = 42
    roi: tuple[int, int, int, int] | None = None
    clip: tuple[float, float, float, float, float, float] | None = None
    width: int = 640
    height: int = 480


#: The camera of the 64 x 48 test lattice.
SMALL_CAMERA = Camera(32.0, 24.0, 54.0, 0.001)
