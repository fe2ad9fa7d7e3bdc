import pytest

from platewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns (or all)."""
    out = [tuple(r) for r in df.collect()]
    idx = [df.columns.index(c) for c in order] if order else range(len(df.columns))
    return sorted(out, key=lambda r: [(r[i] is None, r[i]) for i in idx])
