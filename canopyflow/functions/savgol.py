"""Savitzky-Golay coefficients from window and order, edges by the same polynomial."""

from __future__ import annotations

import numpy as np


def effective_window(window: int) -> int:
    """Odd and at least five, as the filter is applied."""
    return max(5, window if window % 2 else window - 1)


def coefficients(window: int, order: int) -> np.ndarray:
    """Row ``i`` gives the weights for position ``i`` inside a window of values.

    The least-squares polynomial through ``window`` points, evaluated at each of
    them; the middle row is the moving filter, the others serve the two edges.
    """
    positions = np.arange(window) - window // 2
    basis = np.vander(positions, min(order, window - 1) + 1, increasing=True).astype(float)
    return np.round(basis @ np.linalg.pinv(basis), 15)
