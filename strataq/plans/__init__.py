"""All queries on the driver's tables."""

from . import archive, calibration, cases, constraints, dynamics, estimation, fitting, functions, governance, graphs, joins, quality, records, scoring, windows  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
