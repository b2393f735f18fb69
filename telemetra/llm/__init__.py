"""Operators for training-data pipelines over text, pages, vectors and chats.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` applies them to the given tables.
"""
