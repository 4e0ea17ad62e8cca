"""Table readers, derived fixture tables and sinks."""
