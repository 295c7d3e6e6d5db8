"""Sources: record files, calendars, and adapters from star-schema tables."""
