"""Training-data operators: sharding, chat formatting, filtering and several kinds of de-duplication.

Nothing else in the library imports this subpackage; it registers its own queries (``loomlog.llm.queries``).
"""
