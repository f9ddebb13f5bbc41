"""lixora: licence-compliance analytics over fleets of projects, as PySpark DataFrame jobs."""
