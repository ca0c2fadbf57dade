"""doclens: static triage of document corpora as Spark DataFrame operators."""
