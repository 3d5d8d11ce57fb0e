"""Building blocks that turn SQL expression text into SQL expression text.

An operator hands a whole layer of expressions to Spark in one `selectExpr`, which Spark
parses inside the JVM. Building the same layer from Column objects would take thousands
of calls between Python and the JVM and several seconds per query.
"""
