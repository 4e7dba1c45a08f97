import pytest

from quillgrid.session import clear_scratch, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    clear_scratch(session)


@pytest.fixture(scope="session")
def people(spark):
    """Five rows with typos, a gap and an extreme value."""
    rows = [
        (0, "Engineering", 75000, 29.0, "John Doe"),
        (1, "Enginering", 82000, 51.0, "Jane Smith"),
        (2, "Marketing", 68000, None, "Bob Johnson"),
        (3, "Marketng", 71000, 45.0, "Alice Brown"),
        (4, "Sales", 950000, 26.0, "Charlie White"),
    ]
    return spark.createDataFrame(rows, "_rid long, Department string, Salary long, Age double, Name string")
