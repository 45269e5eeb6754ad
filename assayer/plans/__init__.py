"""All registered queries."""

from assayer.plans.registry import ORACLES, QUERIES  # noqa: F401
from assayer.plans import comparison, models, quality, records  # noqa: F401
from assayer.plans.flagship import flagship  # noqa: F401
