"""Sources: panel views over the landed tables, observation payloads, catalog."""
