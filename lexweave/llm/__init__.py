"""Training-data operators: one module per operator, queries in :mod:`lexweave.llm.queries`.

Nothing outside this folder imports it.
"""
