"""Sources and sinks: tables bound as graphs, project trees, parsers, reports."""
