"""Registered queries, and their DuckDB forms, by subject."""

from caseweave.plans import cases, evidence, flows, graphs, linking, reports, sources

MODULES = [flows, linking, graphs, evidence, sources, cases, reports]
