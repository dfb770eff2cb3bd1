"""Plans that compose operators: retrieval, anchoring, verdicts, gates, conflicts, scores."""
