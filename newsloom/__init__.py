"""newsloom: content-intake analytics expressed as Spark plans."""
