import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from apidrift.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", "apidrift-tests", **{
        "spark__sql__shuffle__partitions": "8", "spark__driver__memory": "8g",
    })
    s.sparkContext.setLogLevel("ERROR")
    return s
