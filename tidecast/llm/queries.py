"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from tidecast.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
