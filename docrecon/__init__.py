"""Document reconciliation on Spark."""
