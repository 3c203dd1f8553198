"""newsloom: news-stream analytics as PySpark DataFrame -> DataFrame operators."""
