import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sedimark.session import local_session

    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


def _schemas(spark):
    return {os.path.basename(p)[:-8]: spark.read.parquet(p).schema for p in glob.glob(f"{DATA}/*.parquet")}


#: Names that operators use inside; a table may bring columns of the same names.
CLASHING = "n seq size rank path base suffix k1 k2 words counts rating container_id first kind tail groups prv nxt snap h0 h1 key reason c x e _b".split()


@pytest.fixture(scope="session")
def empty_dir(spark, data, tmp_path_factory):
    """All tables without rows."""
    at = tmp_path_factory.mktemp("empty")
    for name, schema in _schemas(spark).items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="session")
def dirty_dir(spark, data, tmp_path_factory):
    """All tables with rows of nulls only, repeated rows, a null in every column in turn, and clashing extra columns."""
    from pyspark.sql import functions as F

    at = tmp_path_factory.mktemp("dirty")
    for name, schema in _schemas(spark).items():
        rows = spark.read.parquet(f"{data}/{name}.parquet").limit(25)
        nulls = spark.createDataFrame([tuple([None] * len(schema))] * 2, schema)
        parts = rows.unionByName(rows.limit(3)).unionByName(nulls)
        if name != "pack_capacities":
            for i, f in enumerate(schema):
                parts = parts.unionByName(rows.limit(2).withColumn(f.name, F.lit(None).cast(f.dataType)))
        extra = [c for c in CLASHING if c not in schema.names]
        parts.withColumns({c: F.lit(i) for i, c in enumerate(extra)}).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)
