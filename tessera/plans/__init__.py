"""Registered queries over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from . import colours, crawl, duplicates, gallery, garments, links, logs, lookups, markup, orders, pages, parts, profile, records

MODULES = (pages, parts, orders, logs, records, lookups, markup, links, garments, colours, crawl, profile, duplicates, gallery)
QUERIES = {n: q for m in MODULES for n, q in m.R.queries.items()}
ORACLES = {n: s for m in MODULES for n, s in m.R.oracles.items()}
