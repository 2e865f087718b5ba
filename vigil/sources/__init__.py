"""Sources and sinks (survey 2.1)."""
