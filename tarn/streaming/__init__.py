from tarn.streaming.ingest import hourly_stream, ingest

__all__ = ["hourly_stream", "ingest"]
