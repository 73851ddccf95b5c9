"""operators of the quire engine."""
