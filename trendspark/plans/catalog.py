"""All registered queries. Importing the q_* modules fills the registry."""

from trendspark.plans import q_ingest, q_media, q_prompts, q_publish, q_reports, q_sources, q_translate  # noqa: F401
from trendspark.plans.registry import ORACLE, QUERIES

FLAGSHIP = "dashboard"

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
