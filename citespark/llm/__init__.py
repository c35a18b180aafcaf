"""Operators for preparing training data: search, scans, classifiers, near-duplicates, tokens, packing.

Nothing else in the library imports this package. Conventions shared by all operators:

* Only the columns an operator names are read, so extra columns, also ones with clashing names, do not matter.
* Columns that an operator adds replace columns of the same name.
* A NULL text counts as an empty one; rows with NULL or repeated ids are rows of their own and stay in the result.
* Empty tables give empty results with the same schema.
* Whole texts are processed, whatever their length.
"""
