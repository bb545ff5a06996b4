"""Sources of the sequencing analytics engine."""
