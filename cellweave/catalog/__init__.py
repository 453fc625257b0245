"""All registered queries."""

from . import ctes, steps  # noqa: F401
from . import evaluation, expression, ingest, joins, logs, scoring, shape  # noqa: F401
from . import growth  # noqa: F401
