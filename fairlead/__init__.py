"""Vessel-encounter analytics on Spark: DataFrame -> DataFrame operators for AIS position reports."""
