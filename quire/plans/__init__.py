"""The library's queries, each a plan over the supplied tables."""
