from __future__ import annotations

import pytest


@pytest.fixture
def staging(spark):
    from fairlead.sources.tables import Staging

    return Staging(spark)
