"""The event log as a stream: status, pairing, gates, budgets, windows, sessions, incremental upkeep."""
