"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``panelith.llm.queries`` registers the
queries that apply its operators to whole tables.
"""
