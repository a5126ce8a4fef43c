"""Candidate-selection analytics on PySpark. Canonical relation: candidates(problem_id, candidate_index, candidate, label, score, typechecks)."""
