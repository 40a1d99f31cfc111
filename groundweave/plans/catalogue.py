"""All registered queries; importing this module fills the registry."""

from . import q_clustering, q_features, q_grouped, q_masks, q_materials, q_pipeline, q_postproc, q_rasters, q_vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
