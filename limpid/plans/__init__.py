"""Decisions over small per-column statistics: roles, semantics, dashboard specs, the full run."""
