"""Registered queries without SQL run over all cells."""

import os

from pyspark.sql import functions as F

from cladeframe.operators import posterior
from cladeframe.plans import fixtures as fx
from cladeframe.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(repr, (tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())))


def likelihoods(spark):
    return fx.obs(spark, SF).selectExpr("cell", "mut", "ln(0.05 + 0.9 * vaf) AS ll_mut", "ln(0.95 - 0.9 * vaf) AS ll_unmut")


def test_carrier_counts_of_all_cells(spark):
    assert rows(QUERIES["t14_carrier_counts"](spark, SF)) == rows(posterior.carrier_counts(likelihoods(spark)))


def test_site_posteriors_of_all_cells(spark):
    got = QUERIES["t17_site_posteriors"](spark, SF).collect()
    assert len(got) == fx.MUTS and all(abs(r.somatic + r.artifact + r.germline - 1) < 1e-9 for r in got)
