"""Local refinement of proposed boxes: evidence over the low threshold near a box becomes its mask, if there is enough of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parcelflow.operators.evidence import boxes, label
from parcelflow.sources.shipping import ship

# Pixels around a box, least overlap of a piece with it, least pixels, and limits of the four checks (two must hold).
PADDING, OVERLAP, PIXELS, STRUCTURE, COLOR, EDGE, CHECKS = 24, 0.05, 24, 0.2 * 0.7, 0.28, 0.16, 2
_PLANES = ("low", "score", "structure", "color", "edge")
_OUT = (
    "pair_id long, proposal_id long, geometry string, reason string, pixels long, mean_score double, structural double, color_support double, edge_support double, edge_only double, "
    "left int, top int, width int, height int, support binary"
)


def refined(box: tuple[int, int, int, int], planes: dict[str, np.ndarray], threshold: float) -> dict:
    """A box's mask and support; coarse geometry (the box itself, no mask) without enough evidence."""
    left, top, w, h = box
    rows, cols = planes["low"].shape
    y0, x0, y1, x1 = max(0, top - PADDING), max(0, left - PADDING), min(rows, top + h + PADDING), min(cols, left + w + PADDING)
    labels, n = label(planes["low"][y0:y1, x0:x1] > 0)
    some = np.zeros(n + 1, dtype=bool)
    for k, (a, b, c, d, _) in enumerate(boxes(labels, n) if n else []):
        shared = max(0, min(a + x0 + c, left + w) - max(a + x0, left)) * max(0, min(b + y0 + d, top + h) - max(b + y0, top))
        some[k + 1] = shared / max(1, min(c * d, w * h)) >= OVERLAP
    y, x = np.nonzero(some[labels])
    y, x = y + y0, x + x0
    mean = lambda p, of: float((planes[p][y, x] / of).mean()) if len(y) else 0.0
    score, structure, color, edge = mean("score", 255), mean("structure", 255), mean("color", 64), mean("edge", 255)
    checks = (score >= threshold / 255, structure >= STRUCTURE, color >= COLOR, edge >= EDGE)
    out = {"pixels": len(y), "mean_score": score, "structural": structure, "color_support": color, "edge_support": edge, "edge_only": edge if edge > 0.35 and color < 0.35 and structure < 0.3 else 0.0}
    if len(y) < PIXELS or sum(checks) < CHECKS:
        return out | {"geometry": "frontier_bbox", "reason": "local_refinement_failed", "left": left, "top": top, "width": w, "height": h, "support": None}
    bx, by, bw, bh = int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1
    support = np.zeros((bh, bw), np.uint8)
    support[y - by, x - bx] = 1
    return out | {"geometry": "pixel_mask", "reason": "local_refinement_succeeded", "left": bx, "top": by, "width": bw, "height": bh, "support": support.tobytes()}


def refine(proposals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Proposals (pair_id, proposal_id, left, top, width, height) against the planes of their pair.

    pairs: pair_id, frame_width, frame_height, low_threshold and planes of bytes low, score,
    structure, color, edge; one row a pair. Proposals of a pair without planes are left out.
    """

    def one(boxed: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p in planes.itertuples():
            shape = int(p.frame_height), int(p.frame_width)
            own = {k: np.frombuffer(getattr(p, k), np.uint8).reshape(shape) for k in _PLANES}
            for b in boxed.itertuples():
                rows.append({"pair_id": b.pair_id, "proposal_id": b.proposal_id} | refined((int(b.left), int(b.top), int(b.width), int(b.height)), own, float(p.low_threshold)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    ship(proposals.sparkSession)
    boxed = proposals.select("pair_id", "proposal_id", "left", "top", "width", "height").groupBy("pair_id")
    planes = pairs.select("pair_id", "frame_width", "frame_height", "low_threshold", *_PLANES).groupBy("pair_id")
    return boxed.cogroup(planes).applyInPandas(one, _OUT)
