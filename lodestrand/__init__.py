"""Cross-source knowledge-graph analytics as DataFrame plans."""
