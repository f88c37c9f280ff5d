"""The registered queries."""

from lumenframe.plans import clips, evaluation, files, geometry, manifest, media, rewards, streams  # noqa: F401
from lumenframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
