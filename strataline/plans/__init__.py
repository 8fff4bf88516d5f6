"""All queries of the library's own operators: importing this package registers them."""

from strataline.plans import assembly, catalog, coverage, fingerprints, manifests, modeling, parity, readers, reports, sources, streams, validators  # noqa: F401
from strataline.plans.registry import QUERIES, SQL, oracle_sql, queries  # noqa: F401
