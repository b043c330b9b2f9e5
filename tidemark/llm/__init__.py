"""Training-data operators: archives, tokens, fingerprints, packing, chat, quality, duplicates, secrets and URL rules.

Nothing outside this subpackage imports it.
"""
