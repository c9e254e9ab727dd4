"""Sources and sinks: Git repositories, tables, drawings."""
