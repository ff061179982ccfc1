"""tallyforge: double-entry accounting analytics and validation on PySpark."""
