"""sources of the quire engine."""
