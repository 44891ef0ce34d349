"""All registered queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from corpusloom.plans.base import ORACLES, QUERIES

PLANS = ("texts", "codebooks", "vocabularies", "tokens", "alignment", "examples", "features", "decoding", "metrics", "pretraining", "noise", "files")
for _name in PLANS:
    importlib.import_module(f"corpusloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
