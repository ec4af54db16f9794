"""Helpers of the tests; a name that no other folder's module hides."""


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])
