"""casegrid: analytics over communication evidence, declared as Spark DataFrame and SQL plans."""
