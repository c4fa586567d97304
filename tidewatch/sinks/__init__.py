"""Report payloads and the sealed run archive."""
