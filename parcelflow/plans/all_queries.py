"""Imports every query module, so that the registry is complete."""

from parcelflow.plans import (  # noqa: F401
    q_events, q_extraction, q_identity, q_lots, q_pipelines, q_quality, q_scalars, q_sources, q_spatial, q_streaming, q_tenancy,
)
from parcelflow.plans.registry import ORACLES, QUERIES  # noqa: F401
