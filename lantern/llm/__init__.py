"""Training-data operators: chat formatting, token statistics, cleaning, joins, search and sharding.

Nothing else in the library imports this subpackage.
"""
