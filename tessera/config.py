"""Thresholds of the site-event operators, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # sessions of rule violations
    minimum_violation_seconds: float = 1.0
    outside_frames: int = 3
    missing_seconds: float = 12.0
    edge_buffer: float = 0.02
    reid_iou: float = 0.2
    reid_distance: float = 0.08
    # tracks
    initiate_confidence: float = 0.30
    continue_confidence: float = 0.14
    confidence_alpha: float = 0.40
    forget_frames: int = 60
    motion_window: int = 40
    static_speed: float = 0.30
    class_decay: float = 0.78
    class_floor: float = 0.01
    class_forget_frames: int = 120
    # boxes kept over missed frames
    retention_frames: int = 14
    retention_seconds: float = 2.2
    retention_overlap: float = 0.45
    retention_match_overlap: float = 0.20
    retention_match_distance: float = 0.80
    box_alpha: float = 0.45
    box_alpha_overlap: float = 0.10
    # labels of the custom model
    custom_interval: int = 1
    custom_match_overlap: float = 0.18
    custom_near: float = 0.75
    custom_confirm_hits: int = 2
    custom_confirm_frames: int = 8
    custom_confirm_seconds: float = 2.5
    custom_promote_confidence: float = 0.18
    custom_instant_confidence: float = 0.22
    custom_alone_confidence: float = 0.35
    custom_truck_confidence: float = 0.60
    custom_reach: float = 350.0
    custom_revert_confidence: float = 0.50
    stacker_least_aspect: float = 0.65
    stacker_most_aspect: float = 3.50
    stacker_most_area: float = 0.20
    stacker_least_height: float = 0.06
    # shown boxes
    shown_grace_seconds: float = 0.9
    shown_iou: float = 0.2
    shown_distance: float = 0.12
    # frames of one camera with a pause of a whole such slot between them are apart
    pause_seconds: float = 30.0
    # boxes of one frame
    nms_iou: float = 0.35
    nms_iomin: float = 0.60
    vehicle_iou: float = 0.18
    vehicle_iomin: float = 0.42
    assemble_gap: int = 40
    assemble_side: float = 0.20
    assemble_overlap: float = 0.05
    assemble_aspect: float = 5.5
    assemble_rounds: int = 10
    # plates
    plate_cooldown_seconds: float = 20.0
    track_expiry_seconds: float = 1.2
    track_iou: float = 0.30
    track_distance: float = 160.0
    track_least_score: float = 0.35
    plate_box_alpha: float = 0.82
    vehicle_min_width: int = 50
    vehicle_min_height: int = 30
    # clips and datasets
    clip_before_seconds: float = 10.0
    clip_after_seconds: float = 0.5
    ready_samples: int = 20
    ready_labels: int = 1
    ready_sources: int = 3


DEFAULT = Thresholds()
