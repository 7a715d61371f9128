"""All registered queries and their SQL."""

from __future__ import annotations

from . import dimension, evaluation, knowledge, lexical, rules, scalar, sentence, words

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scalar, dimension, words, knowledge, evaluation, sentence, rules, lexical):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
