"""Helpers of the tests; a name of its own, as every test folder has a conftest."""


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
