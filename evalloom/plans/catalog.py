"""Every registered query of the library's own operators, over the given tables, with its SQL twin where SQL can say it."""

from . import answers, corpora, items, reports, texts  # noqa: F401
from .registry import QUERIES, SQL, docs, qa, results, table  # noqa: F401
