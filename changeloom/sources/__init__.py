"""Reading: messages, nested JSON, archives, lookup tables and streams."""
