"""Code-intelligence and hybrid retrieval over Spark tables.

``functions``  scalar expressions, ``sources`` readers and table schemas, ``operators`` retrieval,
navigation, calibration and store operators, ``plans`` the registered queries, ``streaming`` the
change feed.  ``llm`` holds training-data operators; nothing outside it imports it.
"""
