"""Thresholds of the analytics; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


# Defaults of the thresholds.
@dataclass(frozen=True)
class Config:
    hamming_bits: int = 5
    least_positions: int = 2
    frame_slack: int = 5
    tag_threshold: float = 0.105
    tag_strong: float = 0.125
    tag_margin: float = 0.005
    event_support: int = 2
    vision_step: float = 2.0
    search_floor: float = 0.075
    search_band: float = 0.035
    search_limit: int = 300
    file_tolerance_s: int = 90 * 60
    copy_window_s: int = 3 * 86400
    neighbour_gap: int = 20
    neighbour_span_s: int = 36 * 3600
    track_similarity: float = 0.45
    match_threshold: float = 0.40
    core_frontal: float = 0.4
    cluster_threshold: float = 0.24
    attach_threshold: float = 0.32
    attach_margin: float = 0.05
    reject_threshold: float = 0.10
    suggest_threshold: float = 0.12
    suggest_margin: float = 0.03
    cross_fade_s: float = 0.6
    photo_s: float = 3.2
    least_piece_s: float = 2.6
    most_piece_s: float = 7.5
    end_card_s: float = 4.0
    settle_s: int = 120
    least_title_bytes: int = 20 << 20


DEFAULTS = Config()
