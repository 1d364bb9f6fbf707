"""Operators for large training corpora: tokens, duplicates, quality, packing. Nothing else imports them."""
