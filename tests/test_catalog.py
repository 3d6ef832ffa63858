"""Every query of the catalogue against its SQL."""

import pytest
from oracle import compare

from terraspan.plans import catalog

DIR = "/root/testdata/sf0.01"
EMPTY = {"unmatched_ids"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    assert compare(spark, DIR, catalog.QUERIES[name], catalog.ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_small_table(spark):
    """With gaps and short series."""
    for name in ("normalized_anomaly", "wavelet_bands", "windows", "variance_partition"):
        compare(spark, "/root/testdata/sf0.001", catalog.QUERIES[name], catalog.ORACLE[name])
