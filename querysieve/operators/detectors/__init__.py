"""Novelty detectors fitted on benign rows.

Vectors come as a dense ``vec`` array column, or as sparse ``indices`` / ``counts`` columns.
Scores are oriented so that higher means more anomalous.
"""
