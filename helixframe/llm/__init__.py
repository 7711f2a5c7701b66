"""Operators for large training-data corpora (see README, section "Corpus operators").

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
