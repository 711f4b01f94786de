from __future__ import annotations

import io
from contextlib import redirect_stdout


def as_set(df, *columns):
    """Rows as a sorted list of tuples."""
    columns = columns or df.columns
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan_of(df, *, final: bool = False) -> str:
    """Physical plan text; with ``final`` after running, as adaptive execution left it."""
    if final:
        df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
