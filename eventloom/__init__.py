"""Event analytics on Spark: one bitemporal ``events`` table and DataFrame operators over it."""
