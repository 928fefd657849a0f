"""Operators for preparing language-model training data.

Each module holds one operator as functions from DataFrames to DataFrames; ``queries`` binds
them to the given tables.  Nothing outside this folder imports it.

Common to all operators:

* only the columns an operator names are read, so further columns and their names never matter;
* a null text counts as an empty one;
* an empty table gives an empty result with the same schema.
"""
