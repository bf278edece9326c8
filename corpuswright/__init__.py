"""corpuswright: a Spark-first engine for building and auditing text corpora."""
