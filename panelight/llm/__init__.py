"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.  Shared conventions of all operators:

* an operator selects the columns it needs by name and builds its result from
  those, so extra columns (also ones named like an output) never reach it;
* a null text is an empty text; an empty input table gives an empty result
  with the same schema;
* rows that share an id, or are wholly equal, are each reported.
"""
