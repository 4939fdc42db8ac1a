import pytest

from cairn.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
