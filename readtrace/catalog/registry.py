"""All registered queries by name."""

from readtrace.catalog import chain, cohort, eyes, storage, streams, words

GROUPS = (chain, cohort, eyes, words, storage, streams)


def queries():
    return {name: fn for g in GROUPS for name, fn in g.QUERIES.items()}


def statements():
    return {name: text for g in GROUPS for name, text in g.SQL.items()}
