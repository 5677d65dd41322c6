"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this subpackage imports it; it may import from the rest of the
library.  ``queries`` and ``oracles`` collect the ``opN_<name>`` queries.
"""
