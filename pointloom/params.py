"""Settings of the segmentation, with its published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CutPursuitParams:
    """``edge_multiplier``: what a cut edge costs in the flow, in units of weight x regularisation (2 counts each edge in both directions).
    ``cutoff``: components of less weight are merged into a neighbour afterwards; 0 turns that off. ``merge_step``: also undo cuts that don't pay.
    ``start``: how a component's first two sides come about, by its median or by k-means, from ``restarts`` seeded pairs of centres and ``steps`` each."""

    flow_steps: int = 4
    max_rounds: int = 20
    stop_ratio: float = 0.001
    scale: int = 1000
    edge_multiplier: int = 2
    cutoff: float = 0.0
    merge_step: bool = False
    start: str = "median"
    restarts: int = 5
    steps: int = 8
    seed: int = 0


@dataclass(frozen=True)
class SegmentationParams:
    """Distances are in metres. ``origin`` of the voxels: the cloud's mean or its min. ``cluster_label``: how a cluster gets its second label.
    ``min_points``: clouds of fewer points are skipped, and come back with null labels; 0 skips none, twice min_nn1 is another common choice."""

    reg_strength1: float = 1.0
    min_nn1: int = 5
    reg_strength2: float = 15.0
    min_nn2: int = 20
    decimate_res1: float = 0.05
    decimate_res2: float = 0.1
    max_gap: float = 2.0
    rel_height_length_ratio: float = 0.5
    vertical_weight: float = 0.5
    min_nn3: int = 20
    score_candidate_ratio: float = 0.7
    long_stem_ratio: float = 1.5
    outlier_gap: float = 3.0
    trim_percent: float = 0.2
    raster_scale: float = 10.0
    origin: str = "mean"
    cluster_label: str = "first"
    isolate_outliers: bool = False
    min_points: int = 0
    solver: CutPursuitParams = field(default_factory=CutPursuitParams)
