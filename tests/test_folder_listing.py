"""A folder's listing is aggregated before the shuffle."""

from lumenframe import plans


def test_folder_listing_collects_no_group(spark):
    plan = plans.QUERIES["folder_listing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_min" in plan
