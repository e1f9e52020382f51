"""lakeloom: analytics operators written for the Spark DataFrame API."""
