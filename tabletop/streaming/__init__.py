from tabletop.streaming.ingest import ingest_incremental

__all__ = ["ingest_incremental"]
