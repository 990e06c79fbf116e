"""A semantic query engine on Spark: concepts in, one lazy DataFrame out."""
