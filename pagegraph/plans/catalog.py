"""All registered queries; importing the plan modules fills the registry."""

from pagegraph.plans import checks, forms, graph, learned, logs, pages, search  # noqa: F401
from pagegraph.plans.registry import QUERIES, oracles  # noqa: F401
