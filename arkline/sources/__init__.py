"""Sources and sinks: files, archives, catalogs, maps and reports."""
