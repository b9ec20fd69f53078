"""Helpers for frames in tests."""


def values(df):
    """Rows of a small frame as tuples."""
    return [tuple(r) for r in df.collect()]
