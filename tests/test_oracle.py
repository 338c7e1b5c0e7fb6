"""Every registered query with a SQL form gives the rows of its SQL; the others run."""

import pytest
from pyspark.sql import functions as F

from stackweave import plans

from .oracle import FOLDER, of_query, of_sql


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = of_query(spark, plans.QUERIES[name])
    if name in plans.ORACLE:
        assert got == of_sql(plans.ORACLE[name])
    else:
        assert got[0]


def test_whole_tables(spark):
    """Queries reach all stacks and pixels."""
    count = lambda name: plans.QUERIES[name](spark, FOLDER)
    stacks = count("coherence_segments").select("stack").distinct().count()
    assert stacks > 25
    for name in ("coherence_chained", "coherence_pixelwise"):
        assert count(name).select("stack").distinct().count() == stacks
    for name in ("inversion_weighted", "series_velocity_bootstrap"):
        assert count(name).select("row", "col").distinct().count() == count("series_velocity").count()


def test_climatology_by_latitude(spark):
    """Pairs of one day of the year get the levels of their own band and half of the globe."""
    from stackweave.operators import coherence as K
    from stackweave.plans.adapters import latitude

    c = plans.QUERIES["coherence_climatology"](spark, FOLDER)
    assert c.where("coh IS NULL").count() == 0
    path = F.split("stack", ":")[0].cast("long")
    got = {(r["band"], r["south"]): r["n"] for r in c.groupBy(K.band_of(latitude(path)).alias("band"), (latitude(path) < 0).alias("south")).agg(F.count("*").alias("n")).collect()}
    assert len({b for b, _ in got}) > 5 and len({s for _, s in got}) == 2
    fits = {(r["band"], round(r["g_inf"], 4)) for r in K.fit_pixels(K.climatology(spark), ["band", "season"], K.CLIMATOLOGY_LAGS).collect()}
    floors = c.where("n_segments = 1").select(K.band_of(latitude(path)).alias("band"), "floor").distinct().collect()
    assert floors and all(any(b == r["band"] and abs(f - r["floor"]) < 2e-4 for b, f in fits) for r in floors)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_package_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['stackweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    from .conftest import REPO

    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)
