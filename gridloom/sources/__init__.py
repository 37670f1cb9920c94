"""Where cell tables come from: table adapters, run-length masks, rasters."""
