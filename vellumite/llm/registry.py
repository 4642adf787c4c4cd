"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import block_names, chat, decontaminate, importance, lattice_lm, license_scan, line_runs, mixing, quality, sharding, simhash, token_files, turn_repair

_MODULES = (token_files, chat, lattice_lm, decontaminate, block_names, license_scan, simhash, quality, mixing, sharding, importance, line_runs, turn_repair)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
