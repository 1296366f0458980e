"""profilebook: a Spark-native engine for customer-profile (KYC) workflows.

Everything is expressed as DataFrame / SQL operations that run set-wise over
many applications at once.  Sub-packages:

* ``sources``   -- table catalog, stand-in workflow/master tables, schema changes
* ``functions`` -- column functions (null model, dates, code derivations, text)
* ``operators`` -- reusable relational building blocks (lookups, bounded text
                   aggregation, surrogate keys, keyed changes)
* ``plans``     -- the business operators (search, creation manager, upsert,
                   refresh, catalogues)
* ``streaming`` -- Structured Streaming forms of the status write-back and the
                   completeness counts
"""

__version__ = "0.1.0"
