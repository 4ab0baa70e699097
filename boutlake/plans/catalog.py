"""All registered queries of the library."""

from __future__ import annotations

from . import cleaning, evaluating, extending, linking, sources, splitting

_ALL = {**cleaning.Q, **linking.Q, **splitting.Q, **evaluating.Q, **sources.Q, **extending.Q}
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
