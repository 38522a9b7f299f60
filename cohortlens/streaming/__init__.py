from .ingest import append_conformed, read_purchase_stream  # noqa: F401
