"""Plan-level helpers: lineage, components, memoisation, delta encoding."""
