"""fairline: sports-odds analytics as plain Spark DataFrame operators.

Layers: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame),
``models`` (ratings and fitted probabilities as Spark jobs), ``sources`` (feeds and sinks),
``plans`` (back-tests and live comparisons) and ``streaming`` (Structured Streaming forms).
"""
