"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

from pagequarry.plans import anchors, annotations, composition, drawings, files, indexed, ink, joins, layout, names, objects, packages, page_files, profile, recognition, rules, search, statistics, structure, tables, tagged  # noqa: F401  they register themselves
from pagequarry.plans.registry import QUERIES, SQL
from pagequarry.streaming import replay  # noqa: F401

__all__ = ["QUERIES", "SQL"]
