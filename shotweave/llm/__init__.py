"""Operators for preparing training data: counting, cleaning, de-duplicating, scoring and mixing text corpora.

Nothing else in the library imports this subpackage.
"""
