"""Sources and sinks: CSV scan with NA markers, parameter JSON, run log."""
