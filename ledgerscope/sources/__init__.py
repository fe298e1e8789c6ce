"""Sources and sinks: tables in, tables out."""
