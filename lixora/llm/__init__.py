"""Operators for preparing large training corpora; queries are in ``lixora.llm.queries``."""
