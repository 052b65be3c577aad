"""Device identity resolution, check-in risk analytics and corpus operators on PySpark."""
