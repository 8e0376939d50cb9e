import pytest

from spoorline.llm.shipping import ship


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    """Workers find the package wherever the tests are run from."""
    ship(spark)
