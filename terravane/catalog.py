"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from terravane.plans import queries_graph, queries_levels, queries_mesh, queries_paths, queries_points

QUERIES, ORACLES = {}, {}
for _module in (queries_points, queries_paths, queries_graph, queries_mesh, queries_levels):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
