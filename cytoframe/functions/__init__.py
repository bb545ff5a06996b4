"""Functions of the sequencing analytics engine."""
