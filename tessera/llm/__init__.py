"""Training-data operators: text, tokens, media and near-duplicate work at corpus scale.

Nothing outside this subpackage imports it.
"""
