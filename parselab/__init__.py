"""Log-template scoring, error analysis and tuning-set building on PySpark."""
