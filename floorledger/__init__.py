"""Floor-operations ledger: sheet ingest, month-partitioned history and a report catalogue on Spark."""
