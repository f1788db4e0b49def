"""All registered queries. Importing a plan module registers its queries."""
from .registry import ORACLES, QUERIES
from . import basics, columns, dashboards, discovery, ingestion, matching, reports
