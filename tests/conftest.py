import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from testdata_paths import SF001  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rollscope.session import get_spark
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
    s = get_spark("local[4]", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s


@pytest.fixture(scope="session")
def duck():
    from rollscope.plans.check import duck as mk
    return mk(SF001)
