from tavola.sources.domain import Domain  # noqa: F401
