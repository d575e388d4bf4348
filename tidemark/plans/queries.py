"""Assembles the full query catalog from its parts."""

from . import catalog
from . import catalog_profile  # noqa: F401  (registers on import)
from . import catalog_features  # noqa: F401
from . import catalog_models  # noqa: F401
from . import catalog_tests  # noqa: F401
from . import catalog_io  # noqa: F401
from . import catalog_config  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
