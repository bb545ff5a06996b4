"""Plans of the sequencing analytics engine."""
