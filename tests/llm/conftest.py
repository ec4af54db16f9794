import pytest


@pytest.fixture(scope="session")
def write(tmp_path_factory, spark):
    """Write frames as a folder of tables."""

    def make(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, frame in tables.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
