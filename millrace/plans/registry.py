"""Imports every module that registers queries."""

from millrace.functions import domain, markup, measures, text, timeops, udfs, values  # noqa: F401
from millrace.operators import aggregates, filters, fuzzy, joins, sets, windows  # noqa: F401
from millrace.sources import files, race_pages  # noqa: F401
from millrace.streaming import leases, ledgers, replay, runs  # noqa: F401

from .catalog import ORACLES, QUERIES  # noqa: F401
