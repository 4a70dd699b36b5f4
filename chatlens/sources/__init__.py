"""Sources and sinks: parquet tables, chat-export CSV, JSON export, test fixture."""
