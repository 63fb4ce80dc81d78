"""Helpers that the test files import by name."""


def rows(df, *order):
    """Rows as tuples, sorted."""
    return sorted([tuple(r) for r in df.select(*order).collect()], key=str)
