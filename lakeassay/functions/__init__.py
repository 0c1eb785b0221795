"""Part of lakeassay."""
