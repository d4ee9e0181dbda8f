import pytest

from acuity.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    out = session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(shared),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as sorted tuples of its columns."""

    def collect(df, *columns):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))

    return collect
