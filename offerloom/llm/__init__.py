"""Training-data operators: language, toxicity, duplicates, tokens, search and packing.

Nothing outside this subpackage imports it; its queries are registered by
``offerloom.llm.registry``.
"""
