import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from claimweave.session import configure, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("claimweave-tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    release(session)
    session.stop()


NODE_SCHEMA = "graph_id string, pos bigint, id string, type string, text string, description string, doi string, url string, anchor string"
EDGE_SCHEMA = "graph_id string, pos bigint, relation string, subject string, object string, anchor string"


def node_rows(spark, rows, graph_id="g"):
    """Raw nodes from dicts, positions in list order."""
    names = ["id", "type", "text", "description", "doi", "url", "anchor"]
    data = [(graph_id, i, *[row.get(name) for name in names]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, NODE_SCHEMA)


def edge_rows(spark, rows, graph_id="g"):
    """Raw edges from (relation, subject, object[, anchor]) tuples."""
    data = [(graph_id, i, *row, *[None] * (4 - len(row))) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, EDGE_SCHEMA)
