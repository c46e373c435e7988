"""Training-data pipeline operators: quality, sharding, search, mixing, dedup,
tokenisation, secrets and licences. Nothing else in the library imports this
subpackage; its queries are in ``queries`` and its SQL in ``oracle``."""
