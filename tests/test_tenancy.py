"""Key resolution and the admin gate over every customer."""

import pytest

from notegraph.queries import QUERIES


@pytest.mark.parametrize(("name", "key"), [("key_resolution_all", "token_id"), ("admin_check_all", "id")])
def test_every_customer(spark, sf, name, key):
    ids = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    got = [r[0] for r in QUERIES[name](spark, sf).select(key).collect()]
    assert len(ids) > 40 and sorted(got) == sorted(ids)
