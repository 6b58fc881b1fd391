"""Sources and sinks: text, JSON lines, settings and YAML, keyed tables, safe writes, logs, hooks, search engines."""
