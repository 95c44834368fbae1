"""The flagship query: setting roll-up, ratios, densities and parsed settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swarmscope.functions.settings import with_setting_numbers
from swarmscope.operators.rollup import densities, setting_ratios, setting_rollup
from swarmscope.plans.fixtures import bubbles


def setting_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_setting_numbers(densities(setting_ratios(setting_rollup(bubbles(spark, sf_dir)))))
