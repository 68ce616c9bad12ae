"""A Spark-first engine for contest results, their audits and training-text pipelines."""
