"""Ledgerloom: document-to-ledger consolidation and corpus preparation on Apache Spark."""
