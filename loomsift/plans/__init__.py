"""Queries by name: the catalog, entries for single operators, whole requests, and folds of panels."""

from loomsift.plans import catalog, entries, folds, requests

__all__ = ["catalog", "entries", "folds", "requests"]
