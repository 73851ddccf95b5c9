"""functions of the quire engine."""
