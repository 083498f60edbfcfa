"""The registered queries of this subpackage, gathered from their modules."""

from __future__ import annotations

import importlib
import pkgutil

from lodeworks import llm

QUERIES: dict = {}
ORACLES: dict = {}
for _m in sorted(m.name for m in pkgutil.iter_modules(llm.__path__) if m.name.startswith("q_")):
    _found = importlib.import_module(f"lodeworks.llm.{_m}")
    QUERIES |= _found.QUERIES
    ORACLES |= _found.ORACLES
