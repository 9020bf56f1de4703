"""Multi-tenant trade-ledger analytics as PySpark jobs."""
