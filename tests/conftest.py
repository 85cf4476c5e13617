import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        8,
        "tidewright-tests",
        spark__checkpoint__dir=str(shared),
        spark__sql__warehouse__dir=str(shared / "warehouse"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """Rows of a frame as sorted tuples of text, NULL spelled as None."""

    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        found = [tuple(None if v is None else str(v) for v in r) for r in chosen.collect()]
        return sorted(found, key=repr)

    return collect
