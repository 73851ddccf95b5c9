"""streaming of the quire engine."""
