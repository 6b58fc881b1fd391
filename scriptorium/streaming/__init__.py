"""streaming of the document analytics engine."""
