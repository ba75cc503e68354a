"""Operators for large text-training corpora. Nothing outside this subpackage imports it."""
