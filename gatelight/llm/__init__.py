"""Training-data operators. Nothing outside this subpackage imports it except the driver entry and the corpus pipeline."""
