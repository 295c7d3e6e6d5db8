"""Column expressions; UDFs only in ``udf``."""
