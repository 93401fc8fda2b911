"""Thresholds of all operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Candidate pairs
    neighbours_in_flight: int = 4
    pair_radius_m: float = 20.0
    pair_view_deg: float = 20.0
    pair_knn: int = 16
    # Assignment to building faces
    max_standoff_m: float = 40.0
    max_view_deg: float = 25.0
    corner_view_deg: float = 35.0
    merge_normal_deg: float = 15.0
    # Geometry gate
    min_matches: int = 50
    min_inliers: int = 30
    min_inlier_ratio: float = 0.35
    max_median_error_px: float = 3.0
    # Stitch graph
    triangle_px: float = 500.0
    triangle_witnesses: int = 2
    max_chain_weight: float = 12.0
    fallback_mean_drift_px: float = 10.0
    fallback_max_drift_px: float = 20.0
    fallback_uncovered: float = 0.5
    # cracks
    merge_iou: float = 0.2
    cross_image_iou: float = 0.15
    cross_image_centre_px: float = 40.0
    match_iou: float = 0.3
    truth_iou: float = 0.2
    gap_px: float = 60.0
    gap_angle_deg: float = 25.0
    tangent_px: float = 25.0
    min_area_px: float = 15.0
    min_on_wall: float = 0.5
    max_mm_per_px: float = 0.15
    severe_width_mm: float = 0.3
    report_confidence: float = 0.6
    width_edges: tuple[float, ...] = (0.2, 0.3, 0.5, 1.0)
    tile_px: int = 1024
    tile_overlap_px: int = 128
    # labels
    validation_share: float = 0.2


DEFAULT = Config()
