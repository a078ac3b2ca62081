"""Event remapping and log analytics on Spark: column functions, record assembly, sources and sinks."""
