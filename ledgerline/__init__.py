"""ledgerline: a Spark-native engine for corporate financial performance data.

Star schema of Parquet tables, batch / file-stream ingestion with a
nine-rule quality audit, and a fixed library of analytic queries,
all expressed as DataFrame operations (no Python UDFs).
"""

__version__ = "0.1.0"
