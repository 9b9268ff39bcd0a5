"""Record schemas, normalised tables and validated parameters."""
