"""Query catalog: every registered operator/job with its DuckDB oracle SQL."""
