"""quarrymill: resale and marketplace analytics, written as Spark DataFrame plans."""
