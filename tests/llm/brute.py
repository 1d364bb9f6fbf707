"""Helpers of the brute-force versions."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ordered(rows):
    return sorted(rows, key=repr)
