"""operators of the document analytics engine."""
