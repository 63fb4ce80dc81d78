"""Release-exposure analytics on Spark: DataFrame -> DataFrame operators for batch and streams."""
