"""Registered queries over the given tables, each with its SQL counterpart."""

from anamnesis.plans import cohort, scores, sequence, sources, tokens, vectors  # noqa: F401
