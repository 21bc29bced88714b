"""Registered queries: each runs library operators on the given tables; most have a SQL counterpart."""

from evalspark.catalog import (  # noqa: F401  (importing registers the queries)
    answers,
    choice,
    judged,
    preparation,
    prompts,
    replies,
    runs,
    tables,
    texts,
    video,
)
from evalspark.catalog.base import REGISTRY  # noqa: F401
