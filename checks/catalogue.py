"""All registered queries."""

from checks import audits, duplicates, history, plans, quality  # noqa: F401
from checks.registry import ORACLES as _SQL, QUERIES  # noqa: F401
from checks.tables import with_views

ORACLES = {name: with_views(sql) for name, sql in _SQL.items()}
