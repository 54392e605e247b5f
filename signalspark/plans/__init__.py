"""Plans that several tables take part in: dimensions, ingest and views."""
