"""Queries over the star-schema tables, each beside its SQL."""

from evalspark.plans import records  # noqa: F401  (adds its queries)
from evalspark.plans.queries import QUERIES, SQL  # noqa: F401
