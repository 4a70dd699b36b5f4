"""DataFrame -> DataFrame operators (extraction, aggregates, top-k, classification)."""
