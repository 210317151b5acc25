"""All registered queries over the driver's tables, and the SQL that gives the same rows."""

from parcelflow.plans import decisions, evaluation, geometry, masks, matching, proposals, raster, relational, scalars, scouting, thresholds  # noqa: F401  they register
from parcelflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
