"""Settings, cost rules, the index catalog and refresh."""
