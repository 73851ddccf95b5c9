"""plans of the quire engine."""
