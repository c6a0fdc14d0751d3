"""Training-data operators: deduplication, search, mixing, tokenizing, language ID and chat rendering.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
