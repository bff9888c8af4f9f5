"""docloom: document-to-graph analytics as Spark DataFrame transformations."""
