"""An analytics engine on PySpark: relational and graph queries, lake, queue and cache tables, routines."""
