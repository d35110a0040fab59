"""Table scans, sinks and stored results."""
