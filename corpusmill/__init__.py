"""corpusmill: analytics over code and document corpora, written as Spark DataFrame operators."""
