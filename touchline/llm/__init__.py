"""Training-data operators: ten Spark jobs over documents, pages and embeddings.

Each module holds one operator with a general interface; ``catalog`` binds them to
the tables ``documents``, ``embeddings`` and ``pages``. Nothing outside this
subpackage imports it.
"""
