"""All registered queries; importing the modules fills the registry."""

from plumbline.plans import catalog_conditions, catalog_core, catalog_distances, catalog_effects, catalog_ranking, catalog_report, catalog_selection  # noqa: F401
from plumbline.plans.registry import QUERIES, SQL  # noqa: F401
