"""Settings of the corpus operators against those of the session."""

from folioscope.llm import common
from folioscope.session import FILE_FACTOR


def size(spark, name):
    value = spark.conf.get(f"spark.sql.optimizer.runtime.bloomFilter.{name}")
    return int(value.rstrip("m"))


def test_runtime_filters_are_small_and_sized_by_real_files(spark):
    """A filter travels with every closure through the driver; thresholds compare with sizes that the factor has raised."""
    common.settings(spark)
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == str(FILE_FACTOR)
    assert size(spark, "numBits") <= 1 << 21
    assert size(spark, "applicationSideScanSizeThreshold") == 64 * FILE_FACTOR
    assert size(spark, "creationSideThreshold") == 256 * FILE_FACTOR
