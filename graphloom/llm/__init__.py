"""Operators for preparing training corpora, one module each; ``catalog`` holds their queries."""
