"""Operators for texts and statistics of training corpora.  Nothing outside this subpackage imports it."""
