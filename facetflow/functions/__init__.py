"""Column functions, by area."""

from facetflow.operators.features import cell, clamped_score, inverse_sigmoid, l2_normalised, masked_mean, wave_encoding
from facetflow.operators.geometry import decimation_target, discretised, look_at, turned_convention, undiscretised
from facetflow.operators.lifting import front_facing
from facetflow.operators.masks import box_area, box_iou, converted, generalised_iou, near_border, near_crop_edge, run_length_area
from facetflow.operators.text import canonical, colour, pre_tokens

__all__ = [
    "box_area", "box_iou", "canonical", "cell", "clamped_score", "colour", "converted", "decimation_target", "discretised", "front_facing", "generalised_iou",
    "inverse_sigmoid", "l2_normalised", "look_at", "masked_mean", "near_border", "near_crop_edge", "pre_tokens", "run_length_area", "turned_convention", "undiscretised", "wave_encoding",
]
