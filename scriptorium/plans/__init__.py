"""plans of the document analytics engine."""
