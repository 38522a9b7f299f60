"""Training-data operators over the ``documents`` table.

Nothing else in the library imports this subpackage; the registered queries
are in :mod:`cohortlens.llm.queries`.
"""
