"""Table readers, guards, sinks and the delivery view over star-schema tables."""
