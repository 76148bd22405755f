"""Operators for training-data pipelines over ``documents``, ``pages`` and ``embeddings``.

Nothing outside this subpackage imports it; ``queries`` holds the registered
``opN_<name>`` queries with their SQL.
"""
