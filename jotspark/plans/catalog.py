"""All core queries and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

from jotspark.plans import checks, columns, moments, nested, objects, relational, scalars, sequences, texts

MODULES = (relational, columns, texts, nested, scalars, sequences, objects, moments, checks)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
