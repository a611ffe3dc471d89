"""tanglaw: text curation and readability analytics expressed as Spark plans."""
