import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import build

    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = build("local[4]", partitions=4, memory="4g", **{"spark.local.dir": top, "spark.checkpoint.dir": f"file://{top}/checkpoints", "spark.sql.warehouse.dir": f"file://{top}/warehouse", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
