"""Registered queries: operators applied to the test tables, with DuckDB SQL beside them."""

from . import assist, checks, decide, models, retail, series, storage  # noqa: F401  each registers its queries
