"""tessera: a Spark-first engine for site-event analytics and training-data preparation."""
