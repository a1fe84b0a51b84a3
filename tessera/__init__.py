"""A batch analytics engine built on the Spark DataFrame API."""
