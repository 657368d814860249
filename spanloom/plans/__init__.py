"""Plan helpers: sessions, written intermediates, query catalogue."""
