"""trailspark: requirement-to-evidence traceability over many contracts, on Spark.

Every operator takes DataFrames and returns DataFrames (or Columns), is keyed by
``contract_id`` and only builds a plan: nothing here collects to the driver.
"""

__all__ = ["functions", "operators", "plans", "session", "sources"]
