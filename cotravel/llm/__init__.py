"""Training-data pipeline operators (import explicitly; nothing else in the library depends on this package)."""
