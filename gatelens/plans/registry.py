"""All queries of the library by name, and their DuckDB SQL."""

from gatelens.plans import catalog_calibration, catalog_leaves, catalog_runs, catalog_scores, catalog_semantics  # noqa: F401
from gatelens.plans.catalog import QUERIES  # noqa: F401
from gatelens.plans.oracles import ORACLES  # noqa: F401
