import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def values(spark):
    """Evaluates one column expression over literal rows, in row order."""
    def run(rows, ddl, *exprs):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + ddl)
        out = df.select("_i", *[e.alias(f"v{k}") for k, e in enumerate(exprs)]).orderBy("_i").collect()
        return [r[1] if len(exprs) == 1 else tuple(r)[1:] for r in out]
    return run
