"""Sources and sinks: delivered text records, drifting JSON files, LAS, PLY, CSV, rasters."""
