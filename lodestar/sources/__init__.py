"""Reading tables: flat and Hive-partitioned directories, Delta-style logs, footers."""
