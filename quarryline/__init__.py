"""quarryline: product-catalogue analytics as Spark DataFrame and SQL plans."""
