"""An activity-memory engine on Spark: incremental ingest, chunking, deduplication and hybrid search."""
