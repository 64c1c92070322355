"""Context analytics on Spark: text fragments, tags, retrieval, packing, links and data hygiene as DataFrame plans."""
