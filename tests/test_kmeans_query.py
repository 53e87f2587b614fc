"""The k-means query gives every site a cluster and says if the site is nearest to the mean of its own."""

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def test_every_site_has_a_cluster_that_was_checked(spark):
    queries = entry.queries()
    rows = queries["k06_kmeans"](spark, SF_DIR).collect()
    sites = {r["id"] for r in queries["k01_feature_preparation"](spark, SF_DIR).collect()}
    assert len(rows) == len(sites) and {r["id"] for r in rows} == sites
    assert all(r["ok"] and 0 <= r["cluster"] < 4 for r in rows)
