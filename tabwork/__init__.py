"""tabwork: table analysis operators as Spark DataFrame transformations."""
