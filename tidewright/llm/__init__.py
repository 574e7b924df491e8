"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; the entry module adds its queries only if the import succeeds.
"""
