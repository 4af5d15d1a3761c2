"""lodestone: ranked retrieval and corpus preparation expressed as Spark plans."""
