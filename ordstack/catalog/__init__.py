"""All registered queries by name."""

from ordstack.catalog import (  # noqa: F401
    encoders,
    feature_sets,
    models,
    projections,
    relational,
    sources,
)
from ordstack.catalog.registry import REGISTRY  # noqa: F401
