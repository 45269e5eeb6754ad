import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from assayer.functions.cutting import shared_folder
    from assayer.functions.shipping import ship
    from assayer.session import local_session

    session = local_session()
    ship(session)
    shared_folder(session)
    yield session
    session.stop()
