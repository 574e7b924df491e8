"""All registered queries of the reference's operators: name -> (query, DuckDB twin or None)."""


def registered():
    from . import models, primitives, recommend, similarity

    return models.QUERIES | similarity.QUERIES | recommend.QUERIES | primitives.QUERIES
