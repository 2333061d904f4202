"""Training-data operators (mixing, tokenising, filters, joins, search, scoring).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries only if
the package can be imported.
"""
