import os

import pytest

from linespan import queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_partners_at_every_size(spark, sf):
    assert queries.QUERIES["coupling_for_parts"](spark, f"/root/testdata/{sf}").count() > 0
