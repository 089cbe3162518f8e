"""agropanel: Spark DataFrame operators for agricultural panel data."""
