import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("evograph-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from evograph.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="evograph-test-")


def graph(spark, nodes, edges, project="P", version="v1"):
    """Literal graph: nodes = [(id, type, loc, complexity, coupling, depth)], edges = [(s, t, type)]."""
    n = spark.createDataFrame(
        [(project, version, i, nid, nid.split(".")[-1], t, f"{nid}.java", loc, cx, cp, d)
         for i, (nid, t, loc, cx, cp, d) in enumerate(nodes)],
        "project string, version string, ord bigint, id string, name string, type string, file_path string, "
        "loc bigint, complexity bigint, coupling bigint, inheritance_depth bigint")
    e = spark.createDataFrame([(project, version, i, s, t, ty) for i, (s, t, ty) in enumerate(edges)],
                              "project string, version string, ord bigint, source string, target string, type string")
    return n, e
