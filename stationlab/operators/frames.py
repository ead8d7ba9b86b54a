"""Rolling frames of numpy columns, in constant work per value whatever the frame.

A line is cut into chunks as long as the frame.  A frame is then the head of its own chunk and the tail of the chunk before,
each a running aggregate, merged pairwise.  Nothing is subtracted that the frame does not hold: sums are taken of distances to
the first value of a head, or the last of a tail, which every such head or tail holds.
"""

import numpy as np


def _running(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Along each row: count, mean, sum of squared distances to it, least and greatest so far; not-a-number is missing."""
    on = np.isfinite(values)
    first = np.take_along_axis(values, on.argmax(1)[:, None], 1)
    apart = np.where(on, values - np.where(np.isfinite(first), first, 0.0), 0.0)
    n = on.cumsum(1)
    known = np.maximum(n, 1)
    sums, squares = apart.cumsum(1), (apart * apart).cumsum(1)
    low = np.minimum.accumulate(np.where(on, values, np.inf), 1)
    high = np.maximum.accumulate(np.where(on, values, -np.inf), 1)
    return n, np.where(n > 0, first + sums / known, 0.0), np.maximum(squares - sums * sums / known, 0.0), low, high


def rolling(line: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation over each value and the ``rows`` before it; what is not finite counts as missing.

    Not-a-number where there is no value, or for the deviation only one.  Equal values have exactly their own mean
    and no deviation.
    """
    size, width = len(line), rows + 1
    chunks = max(1, -(-size // width))
    laid = np.full(chunks * width, np.nan)
    laid[:size] = np.where(np.isfinite(line), line, np.nan)
    laid = laid.reshape(chunks, width)
    head = _running(laid)
    tail = [x[:, ::-1] for x in _running(laid[:, ::-1])]

    def before(x: np.ndarray, empty: float) -> np.ndarray:
        """What a value's frame holds of the chunk before: from the place after its own."""
        out = np.full((chunks, width), empty, x.dtype)
        out[1:, :-1] = x[:-1, 1:]
        return out

    tail = [before(x, empty) for x, empty in zip(tail, (0, 0.0, 0.0, np.inf, -np.inf))]
    (n1, m1, v1, low1, high1), (n2, m2, v2, low2, high2) = tail, head
    n = n1 + n2
    known = np.maximum(n, 1)
    gap = np.where((n1 > 0) & (n2 > 0), m1 - m2, 0.0)
    mean = np.where(n2 > 0, m2 + gap * (n1 / known), m1)
    square = v1 + v2 + gap * gap * (n1 * (n2 / known))
    low, high = np.minimum(low1, low2), np.maximum(high1, high2)
    same = low == high
    mean = np.where(same, low, np.where(n > 0, mean, np.nan))
    deviation = np.where(n > 1, np.where(same, 0.0, np.sqrt(square / np.maximum(n - 1, 1))), np.nan)
    return mean.ravel()[:size], deviation.ravel()[:size]
