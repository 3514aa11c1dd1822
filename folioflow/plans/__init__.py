"""Registered queries; importing this package registers all of them."""

from folioflow.plans import batches, catalogues, folds, guards, operations, places, queries, readers, rules, stateful, stores, texts, threads  # noqa: F401
