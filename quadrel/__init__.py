"""quadrel: RDF quads, SPARQL queries and large-scale quad processing on Spark DataFrames."""
