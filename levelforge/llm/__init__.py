"""Operations of a training-data pipeline, each a Spark job over whole tables.

Nothing outside this subpackage imports it; its queries are registered by
``__spark_entry__`` only when it can be imported.
"""
