"""Calibration: labelled series to samples and to the curves in force."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from canopyflow.operators import calibration, profiles


@dataclass(frozen=True)
class Calibration:
    samples: DataFrame
    rejects: DataFrame
    curves: DataFrame


def calibrate(observations: DataFrame, labels: DataFrame, keys: Sequence[str], literature: DataFrame,
              created_at: str, existing: DataFrame | None = None) -> Calibration:
    """Samples from raw (unsmoothed) series with ``labels(keys, class, ...)``.

    ``labels`` may carry season, municipality, note and geometry.
    """
    profile = profiles.monthly_profile(observations, keys)
    samples, rejects = calibration.build_samples(profile.join(labels, list(keys)), created_at)
    pool = samples if existing is None else existing.unionByName(samples)
    curves = calibration.reference_curves(literature, calibration.mean_curves(pool, literature))
    return Calibration(samples, rejects, curves)
