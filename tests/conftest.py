import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandwise.runtime import local_session

    session = local_session("4", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="37")
    session.sparkContext.setLogLevel("ERROR")
    return session
